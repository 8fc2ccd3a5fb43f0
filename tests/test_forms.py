"""Cost forms, tiles, scattered points, repairs, simulated scenes and TIFF files."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isophase import api
from isophase.operators import truth as tr
from isophase.plans import tiled
from isophase.solver import mcf, network, repair
from isophase.sources import tiff

TAU = 2 * np.pi


def scene(n=48, noise=0.7, seed=3):
    x = np.linspace(-1, 1, n)
    truth = TAU * (x[:, None] + x[None, :])
    return truth, mcf.wrap(truth + np.random.default_rng(seed).normal(0, noise, (n, n)))


def right(unw, truth):
    k = np.rint((unw - truth) / TAU)
    return (k == np.median(k)).mean()


def cheaper_cycle(tail, head, cost, flow):
    """Whether the residual graph has a cycle of negative price (Bellman-Ford from everywhere)."""
    arcs = [(a, b, cost.price(e, int(flow[e]), 1)) for e, (a, b) in enumerate(zip(tail, head, strict=True))]
    arcs += [(b, a, cost.price(e, int(flow[e]), -1)) for e, (a, b) in enumerate(zip(tail, head, strict=True))]
    a, b, w = (np.array(x, np.int64) for x in zip(*arcs, strict=True))
    dist = np.zeros(max(a.max(), b.max()) + 1, np.int64)
    for _ in range(len(dist) + 1):
        new = dist.copy()
        np.minimum.at(new, b, dist[a] + w)
        if (new == dist).all():
            return False
        dist = new
    return True


@pytest.mark.parametrize("seed", range(4))
def test_flows_are_optimal(seed):
    rng = np.random.default_rng(seed)
    m, n = 14, 17
    phase = rng.uniform(-np.pi, np.pi, (m, n))
    supply = mcf.residues(phase)
    pick = lambda *s: rng.integers(0, 60, s)
    c = mcf.Costs(pick(m, n - 1), pick(m, n - 1), pick(m - 1, n), pick(m - 1, n))
    f = mcf.solve(supply, c)
    assert mcf.objective(c, *f) == mcf.objective(c, *network.solve_grounded(supply, c.down, c.up, c.left, c.right))
    tail, head = network.frame_edges(m, n)
    edge = network.rim(m, n)
    tail, head = np.append(tail, edge), np.append(head, np.full(len(edge), supply.size))
    zero = np.zeros(len(edge), np.int64)
    linear = network.Linear(np.concatenate([c.down.ravel(), c.left.ravel(), zero]), np.concatenate([c.up.ravel(), c.right.ravel(), zero]))
    convex = network.Quadratic(np.append(rng.integers(-120, 120, len(tail) - len(edge)), zero), np.append(rng.integers(0, 30, len(tail) - len(edge)), zero))
    for cost in (linear, convex):
        flow = network.route(np.append(supply.ravel(), -supply.sum()), tail, head, cost)
        left = np.append(supply.ravel(), -supply.sum())
        np.subtract.at(left, tail, flow)
        np.add.at(left, head, flow)
        assert not left.any() and not cheaper_cycle(tail, head, cost, flow)


def test_many_residues_balance():
    rng = np.random.default_rng(3)
    i, j = np.indices((30, 125))
    phase = mcf.wrap(0.35 * (i + j) + rng.uniform(0, 5.5, i.shape))
    costs = mcf.statistical_costs(phase, rng.uniform(0.1, 1, i.shape), rng.random(i.shape) < 0.95, 5.0)
    c_h, c_v = mcf.solve(mcf.residues(phase), costs)
    k = mcf.integrate(phase, c_h, c_v)
    assert (np.diff(k, axis=0) == np.round((phase[:-1] - phase[1:]) / TAU) + c_v).all()


def test_convex_by_enumeration():
    rng = np.random.default_rng(5)
    tail, head = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 2])
    for _ in range(20):
        cost = network.Quadratic(rng.integers(-150, 150, 4), rng.integers(0, 9, 4))
        supply = rng.integers(-1, 2, 3)
        supply[2] = -supply[:2].sum()
        best = None
        for f in itertools.product(range(-4, 5), repeat=4):
            f = np.array(f)
            out = np.zeros(3, np.int64)
            np.add.at(out, tail, f)
            np.subtract.at(out, head, f)
            if (out == supply).all():
                best = min(filter(lambda x: x is not None, (best, cost.total(f))))
        assert cost.total(network.route(supply, tail, head, cost)) == best


@pytest.mark.parametrize("form", ["linear", "convex", "grounded"])
def test_forms(form):
    truth, phase = scene()
    ok = np.ones(phase.shape, bool)
    ok[20:24, :30] = False
    unw, _ = api.unwrap_arrays(phase, np.full(phase.shape, 0.6), ok, 5.0, api.Options(form=form, ground=30, bridge=False))
    assert right(unw[ok], truth[ok]) > 0.99 and np.isnan(unw[~ok]).all()


def test_variance_form_and_unknown_form():
    truth, phase = scene()
    ok = np.ones(phase.shape, bool)
    assert right(api.unwrap_variance_arrays(phase, np.full(phase.shape, 0.5), ok), truth) > 0.99
    with pytest.raises(ValueError):
        api.unwrap_arrays(phase, ok * 0.5, ok, 5.0, api.Options(form="other"))


def test_tiled_frame(spark):
    truth, phase = scene()
    i, j = np.indices(phase.shape)
    pdf = pd.DataFrame({"frame_id": "a", "i": i.ravel(), "j": j.ravel(), "psi": phase.ravel(), "corr": 0.6, "mask": True})
    got = tiled.unwrap_tiled(spark.createDataFrame(pdf), 48, 48, 5.0, 24, 8).toPandas()
    assert len(got) == phase.size and right(got.unw, truth[got.i, got.j]) > 0.99
    one = tiled.unwrap_tiled(spark.createDataFrame(pdf), 48, 48, 5.0, 64, 8).toPandas()
    assert len(one) == phase.size and right(one.unw, truth[one.i, one.j]) > 0.99


def test_reconcile_overrules_a_weak_wrong_seam():
    off = np.random.default_rng(2).integers(-5, 6, (4, 5))
    off -= off[0, 0]
    t = np.arange(20).reshape(4, 5)
    seams = {(int(t[i, j]), int(t[i, j + 1])): (int(off[i, j + 1] - off[i, j]), 100) for i in range(4) for j in range(4)}
    seams |= {(int(t[i, j]), int(t[i + 1, j])): (int(off[i + 1, j] - off[i, j]), 100) for i in range(3) for j in range(5)}
    seams[(6, 7)] = (seams[(6, 7)][0] + 2, 3)
    assert (network.reconcile(4, 5, seams) == off).all()


def test_points(spark):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(0, 10, (2, 300))
    truth = 1.2 * x + 0.8 * y
    phase = mcf.wrap(truth + rng.normal(0, 0.1, 300))
    phase[5] = np.nan
    ok = np.isfinite(phase)
    unw = network.unwrap_points(x, y, phase, np.full(300, 0.1))
    assert right(unw[ok], truth[ok]) == 1 and np.isnan(unw[5])
    far = np.where(np.arange(300) < 150, x, x + 1000)
    assert np.isnan(network.unwrap_points(far, y, phase, np.full(300, 0.1), 20.0)[150:]).all()
    assert np.isnan(network.unwrap_points([0.0], [0.0], [np.nan], [1.0])).all() and network.unwrap_points([0.0, 1.0], [0.0, 0.0], [3.0, -3.0], [1.0, 1.0])[1] == pytest.approx(TAU - 3)
    same = network.unwrap_points([0.0, 0, 1, 0, 1], [0.0, 0, 0, 1, 1], [0.1, 0.1, 0.2, 0.3, 0.4], np.ones(5))
    assert same == pytest.approx([0.1, 0.1, 0.2, 0.3, 0.4])
    pdf = pd.DataFrame({"frame_id": "a", "pid": range(300), "x": x, "y": y, "phase": phase, "variance": 0.1})
    got = api.unwrap_points(spark.createDataFrame(pdf)).toPandas().set_index("pid").unw.sort_index().to_numpy()
    np.testing.assert_allclose(got, unw)


def test_delaunay_circles_are_empty():
    x, y = np.random.default_rng(4).uniform(0, 1, (2, 60))
    tri = network.delaunay(x, y)
    for a, b, c in tri:
        ax = np.array([[x[b] - x[a], y[b] - y[a]], [x[c] - x[a], y[c] - y[a]]])
        mid = np.linalg.solve(2 * ax, (ax**2).sum(axis=1)) + [x[a], y[a]]
        assert (np.hypot(x - mid[0], y - mid[1]) > np.hypot(x[a] - mid[0], y[a] - mid[1]) - 1e-9).all()


def test_slivers_holes_and_anchor():
    truth = np.add.outer(np.arange(30) * 0.2, np.arange(40) * 0.2)
    ok = np.ones(truth.shape, bool)
    step = truth.copy()
    step[:, 30:] += TAU  # a fringe step, not a sliver
    torn = step.copy()
    torn[:, 10:13] += TAU
    torn[5, 20] -= 2 * TAU
    assert np.abs(repair.heal_slivers(torn, np.full(truth.shape, 0.9), ok) - step).max() < 1e-9
    hole = truth.copy()
    hole[5:9, 5:9] = np.nan
    assert not np.isnan(repair.fill_from_neighbours(hole)).any() and np.isnan(repair.fill_from_neighbours(np.full((3, 3), np.nan))).all()
    regions = np.where(np.arange(40) < 30, 1, 2) * np.ones((30, 1), int)
    assert np.abs(repair.anchored(step, regions, np.ones(truth.shape), truth + 0.3) - truth).max() < 1e-9


def test_tiff(spark, tmp_path):
    for kind in ("f4", "f8", "u1", "u2", "i2", "i4"):
        grid = (np.arange(700 * 13).reshape(700, 13) % 200).astype(kind)
        back = tiff.decode(tiff.encode(grid))
        assert back.dtype == grid.dtype and (back == grid).all()
    with pytest.raises(ValueError):
        tiff.decode(b"not a tiff file")
    with pytest.raises(ValueError):
        tiff.encode_labels(np.array([[65536]]))
    assert tiff.read_mask(tiff.encode(np.array([[0.0, np.nan, 2.0]]))).tolist() == [[False, False, True]]
    i, j = np.indices((5, 7))
    pdf = pd.concat([pd.DataFrame({"frame_id": f, "i": i.ravel(), "j": j.ravel(), "v": (i * 7 + j + s).ravel().astype("float32")}) for f, s in (("a", 0), ("b", 100))])
    done = tiff.write_tiffs(spark.createDataFrame(pdf), str(tmp_path)).collect()
    assert sorted(r.frame_id for r in done) == ["a", "b"] and sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]
    got = tiff.tiff_pixels(spark, str(tmp_path)).toPandas().sort_values(["frame_id", "i", "j"])
    assert (got.v.to_numpy() == pdf.v.to_numpy()).all()


def test_simulated_scene(spark):
    ramp = tr.diagonal_ramp(spark, 20, 30)
    ends = ramp.agg(F.min("truth"), F.max("truth")).first()
    assert ends == pytest.approx((-6 * np.pi, 6 * np.pi))
    bump = tr.gaussian_bump(spark, 21, 21, 8.0, 4.0)
    assert bump.where("i = 10 and j = 10").first().truth == pytest.approx(8.0)
    noisy = tr.simulated(bump, F.lit(0.85), 10, 42).toPandas()
    assert abs(noisy["corr"].mean() - 0.85) < 0.05 and (np.abs(mcf.wrap(np.arctan2(noisy.im, noisy.re) - noisy.truth)) < 1.5).all()

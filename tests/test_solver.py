"""The solver against truth and brute force, and the sources and helpers around it."""

import itertools
import json

import numpy as np
import pytest

from isophase import api
from isophase.functions import phase as ph
from isophase.operators import closure, costs
from isophase.solver import mcf
from isophase.sources import flat
from isophase.streaming import resume

TAU = 2 * np.pi


def error(unw, truth, ok):
    d = (unw - truth)[ok]
    return np.abs(d - np.median(d)).max()


def ramp(n, lim):
    x = np.linspace(-lim, lim, n)
    return np.pi * (x[:, None] + x[None, :])


def test_ramp_and_hole():
    truth = ramp(96, 3)
    ok = np.ones(truth.shape, bool)
    unw, label = api.unwrap_arrays(mcf.wrap(truth), np.full(truth.shape, 0.999), ok, 1.0)
    assert error(unw, truth, ok) < 1e-2 and (label == 1).all()
    yy, xx = np.indices(truth.shape)
    ok = (yy - 48) ** 2 + (xx - 48) ** 2 > 20**2
    unw, _ = api.unwrap_arrays(np.where(ok, mcf.wrap(truth), 0), np.where(ok, 0.999, 0), ok, 1.0)
    assert error(unw, truth, ok) < 1e-2 and np.isnan(unw[~ok]).all()


def test_congruence_on_noise():
    rng = np.random.default_rng(4)
    phase = mcf.wrap(ramp(48, 1) + rng.normal(0, 1.2, (48, 48)))
    res = mcf.residues(phase)
    assert res.sum() == 0 and (res != 0).any()
    corr = np.full(phase.shape, 0.5)
    cost = mcf.statistical_costs(phase, corr, np.ones(phase.shape, bool), 5.0)
    c_h, c_v = mcf.solve(res, cost)
    k = mcf.integrate(phase, c_h, c_v)
    n_v = np.round((phase[:-1] - phase[1:]) / TAU) + c_v
    assert (np.diff(k, axis=0) == n_v).all()  # any path gives the same


def test_least_cost_by_enumeration():
    rng = np.random.default_rng(7)
    table = list(itertools.product((-1, 0, 1), repeat=7))
    for _ in range(25):
        phase = rng.uniform(-np.pi, np.pi, (2, 3))
        pick = lambda *s: rng.integers(0, 20, s)
        cost = mcf.Costs(pick(2, 2), pick(2, 2), pick(1, 3), pick(1, 3))
        res = mcf.residues(phase)
        got = mcf.solve(res, cost)
        best = None
        for t in table:
            c_h, c_v = np.array(t[:4]).reshape(2, 2), np.array(t[4:]).reshape(1, 3)
            if (res[1:-1, 1:-1] + c_h[:-1] + c_v[:, 1:] - c_h[1:] - c_v[:, :-1] == 0).all():
                value = mcf.objective(cost, c_h, c_v)
                best = value if best is None else min(best, value)
        assert mcf.objective(cost, *got) == best


def test_bridge_levels_regions():
    truth = ramp(64, 0.5)
    ok = np.ones(truth.shape, bool)
    ok[:, 30:33] = False
    moved = np.where(np.arange(64)[None, :] > 31, truth + 3 * TAU, truth)
    out = mcf.bridge(np.where(ok, moved, np.nan), mcf.label(ok), 100)
    assert error(out, truth, ok) < 1e-6


def test_labels():
    mask = np.ones((6, 9), bool)
    mask[:, 4] = False
    got = mcf.label(mask)
    assert got.max() == 2 and got[0, 0] == 1 and got[0, 8] == 2 and (got[:, 4] == 0).all()


def test_filters():
    rng = np.random.default_rng(2)
    truth = ramp(64, 2)
    noisy = np.exp(1j * (truth + rng.normal(0, 0.6, truth.shape)))
    out = mcf.goldstein(noisy, 0.8, 32)
    assert np.abs(np.angle(out * np.exp(-1j * truth))).mean() < np.abs(np.angle(noisy * np.exp(-1j * truth))).mean()
    w = np.ones(truth.shape)
    w[20:24, 20:24] = 0
    holed = np.where(w > 0, np.exp(1j * truth), 1.0)
    filled = mcf.interpolate(holed, w, most=21)
    assert np.abs(np.angle(filled * np.exp(-1j * truth)))[20:24, 20:24].max() < 0.5


def test_known_values():
    assert [ph.threshold_from_cycle_probability(p) for p in (2.4e-4, 1e-3, 1e-5)] == [50, 41, 69]
    assert [ph.threshold_from_sigma(s) for s in (3.5, 3, 4)] == [50, 40, 62]
    assert ph.min_coherence_auto(16) == pytest.approx(0.08)
    with pytest.raises(ValueError):
        ph.looks(float("nan"))
    a = np.linspace(-np.pi, np.pi, 20001)
    for g, n in ((0.3, 1), (0.6, 5), (0.95, 16)):
        assert np.trapezoid(costs.phase_pdf(a, g, n), a) == pytest.approx(1, abs=1e-3)
    table = costs.CarballoTable(5)
    assert table(np.array([0.5]), np.array([np.pi]))[0] == pytest.approx(0, abs=0.02) and table(np.array([0.5]), np.array([-1.0]))[0] == 50


def test_mask_policies(spark):
    codes = [0, 1, 10, 11, 12, 100, 101, 110, 111, 112, 255]
    df = spark.createDataFrame([(c,) for c in codes], "c int")
    got = df.select("c", *(ph.mask_policy(df.c, p).cast("int").alias(p) for p in ("subswath", "water_only", "water_and_subswath"))).orderBy("c").collect()
    assert [r.subswath for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 1, 1, 0]
    assert [r.water_only for r in got] == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert [r.water_and_subswath for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0]


def test_unwrap_frames(spark):
    rows = [(f, i, j, float(mcf.wrap(np.array(0.3 * (i + j) + k))), 0.95, True) for k, f in enumerate("ab") for i in range(24) for j in range(24)]
    got = api.unwrap(spark.createDataFrame(rows, "frame_id string, i int, j int, psi double, corr double, mask boolean"), 5.0).collect()
    for f in "ab":
        d = np.array([r.unw - 0.3 * (r.i + r.j) for r in got if r.frame_id == f])
        assert len(d) == 576 and np.ptp(d) < 1e-6


def test_triangle_closure():
    g = closure.TemporalGraph(3, ((0, 1), (1, 2), (0, 2)))
    assert len({c for c, _, _ in g.cycles()}) == 1 and len(g.triangles()) == 3
    with pytest.raises(ValueError):
        closure.TemporalGraph(2, ((1, 1),))
    with pytest.raises(ValueError):
        closure.TemporalGraph(3, ((0, 1),)).spanning_tree()


def test_flat_layouts(spark, tmp_path):
    unw, amp = np.arange(12, dtype=np.float32).reshape(3, 4), np.ones((3, 4), np.float32)
    two = flat.write_altline(amp, unw)
    assert (flat.read_floats(two, flat.Meta(4, 3)) == unw).all()
    assert (flat.read_floats(flat.write_floats(unw, True), flat.Meta(4, 3, True)) == unw).all()
    assert (flat.read_floats(amp.tobytes() + unw.tobytes(), flat.Meta(4, 3, False, "bsq")) == unw).all()
    assert (flat.read_floats(np.stack([amp, unw], 2).tobytes(), flat.Meta(4, 3, False, "altsample")) == unw).all()
    with pytest.raises(ValueError):
        flat.read_floats(two, flat.Meta(4, 5))
    assert flat.parse_sidecar("x.rsc", "WIDTH 4\nFILE_LENGTH 3\n") == flat.Meta(4, 3)
    assert flat.parse_sidecar("x.par", "width: 7 m\nnlines: 9\n") == flat.Meta(7, 9, True)
    assert flat.resolve(flat.Meta(5), flat.Meta(4, 3, True, "bsq")) == flat.Meta(5, 3, True, "bsq")
    (tmp_path / "f1.unw").write_bytes(unw.tobytes())
    got = flat.flat_pixels(spark, str(tmp_path), flat.Meta(4)).orderBy("i", "j").collect()
    assert [r.v for r in got] == unw.ravel().tolist() and got[0].frame_id == "f1"


def test_log_is_handled_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    seen = []
    handle = lambda batch, n: seen.extend(r.job_id for r in batch.collect())
    for jobs in (["a", "b"], [], ["c"]):
        if jobs:
            (tmp_path / "log" / f"{jobs[0]}.json").write_text("".join(json.dumps({"job_id": j, "returncode": 0}) + "\n" for j in jobs))
        resume.drain(resume.run_log(spark, str(tmp_path / "log")), handle, str(tmp_path / "at"))
    assert sorted(seen) == ["a", "b", "c"]

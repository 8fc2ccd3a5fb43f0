"""What frames of many rows need: work that grows with their pixels only, and no task that holds a whole frame."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isophase import api
from isophase.operators import costs as co
from isophase.operators import frames as fr
from isophase.operators import stencil as st
from isophase.operators import truth as tr
from isophase.plans import tiled
from isophase.solver import mcf, network

TAU = 2 * np.pi


def raster(spark, grid, name, **more):
    i, j = np.indices(grid.shape)
    return spark.createDataFrame(pd.DataFrame({"frame_id": "a", "i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"), name: grid.ravel(), **more}))


@pytest.mark.parametrize("k", [1, 3, 300])
def test_erosion_over_blocks(spark, k, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", 8)
    mask = np.random.default_rng(k).random((61, 7)) > 0.03
    got = {(r.i, r.j) for r in st.eroded(raster(spark, mask, "mask"), k).where("mask").collect()}
    bad = np.argwhere(~mask)
    want = {(i, j) for i, j in np.argwhere(mask).tolist() if (np.abs(bad - (i, j)).sum(axis=1) > k).all()}
    assert got == want


def test_erosion_of_a_long_column(spark):
    """A column of 100,000 pixels: a running minimum taken anew at each row took 10^10 / 2 steps."""
    p = spark.range(100_000, numPartitions=1).select(F.lit("a").alias("frame_id"), F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), (F.col("id") != 50_000).alias("mask"))
    began = time.time()
    assert st.eroded(p, 2).where("not mask").count() == 5
    assert time.time() - began < 30


def test_columns_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    psi, n = rng.uniform(-3, 3, (37, 5)), 37
    p = raster(spark, psi, "psi", corr=0.5, mask=True)
    labels = raster(spark, rng.integers(1, 4, psi.shape), "label")
    out = []
    for size in (5, 1000):
        monkeypatch.setattr(st, "BLOCK", size)
        out.append([sorted(map(tuple, f.collect())) for f in (st.edges(p), st.residues(p), st.frame_deposits(p), st.boundary_pixels(labels), st.itoh(p))])
    assert out[0] == out[1] and len(out[0][0]) == n * 4 + (n - 1) * 5


def test_no_window_over_a_whole_column(spark):
    p = raster(spark, np.zeros((600, 2)), "psi", corr=0.5, mask=True)
    lines = st._blocked(p, after=1).groupBy("frame_id", "_b", "j").count()
    assert lines.agg(F.max("count")).first()[0] == st.BLOCK + 1 and lines.where("_b >= 0").count() == 6


def test_open_water_of_a_long_column(spark):
    p = spark.range(100_000, numPartitions=1).select(F.lit("a").alias("frame_id"), F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.when(F.col("id") % 1000 == 0, 11).otherwise(111).cast("int").alias("code"))
    began = time.time()
    assert st.open_water_mask(p, 25).where("mask").count() == 51 * 100 - 25
    assert time.time() - began < 30


@pytest.mark.parametrize("rows,tile,overlap", [(9, 10, 3), (10, 10, 3), (23, 10, 3), (24, 10, 3), (95, 30, 6), (40, 7, 6)])
def test_tiles_of_each_pixel(spark, rows, tile, overlap):
    got = fr.decomposed(raster(spark, np.zeros((rows, 4)), "v"), rows, 4, tile, overlap)
    starts = fr.tile_starts(rows, tile, overlap)
    want = sorted((i, t) for i in range(rows) for t, s in enumerate(starts) if s <= i < s + tile)
    assert sorted((r.i, r.tile_r) for r in got.where("j = 0").collect()) == want


def test_plan_of_many_tiles_is_small(spark):
    p = raster(spark, np.zeros((4, 4)), "v")
    plan = lambda rows: len(fr.decomposed(p, rows, 4, 30, 6)._jdf.queryExecution().analyzed().toString())
    assert plan(500_000) < plan(500) + 200


def test_seams_of_a_long_frame():
    """The ground is next to every rim node; searches that went on through it took time quadratic in the rows."""
    rng, rows = np.random.default_rng(2), 3000
    tile = np.arange(rows * 5).reshape(rows, 5)
    near = [*zip(tile[:, :-1].ravel(), tile[:, 1:].ravel(), strict=True), *zip(tile[:-1].ravel(), tile[1:].ravel(), strict=True)]
    seams = {(int(a), int(b)): (int(rng.integers(-1, 2)), int(rng.integers(1, 90))) for a, b in near}
    began = time.time()
    assert network.reconcile(rows, 5, seams).shape == (rows, 5) and time.time() - began < 30


def test_tiles_of_a_frame_with_a_gap(spark):
    """Two scenes 30,000,000 rows apart: all tiles in between were listed, and reconciled as seams without pixels."""
    assert fr.tile_ends(2**31 - 1, 30, 6) == (89478486, 2**31 - 31)
    rows, cols, far = 30_000_048, 40, 30_000_000
    i, j = np.indices((48, cols))
    truth = 0.6 * i + 0.4 * j
    pdf = pd.concat(pd.DataFrame({"frame_id": "a", "i": (i + d).ravel().astype("int32"), "j": j.ravel().astype("int32"), "psi": mcf.wrap(truth).ravel(), "corr": 0.9, "mask": True}) for d in (0, far))
    began = time.time()
    got = tiled.unwrap_tiled(spark.createDataFrame(pdf), rows, cols, 5.0, 24, 8).toPandas()
    assert time.time() - began < 25 and len(got) == 2 * truth.size
    for d in (0, far):
        own = got[(got.i >= d) & (got.i < d + 48)]
        off = own.unw - truth[own.i - d, own.j]
        assert len(own) == truth.size and np.ptp(off) < 1e-6


def test_points_of_a_lattice():
    """Rounding left points of a lattice out of the triangulation; and 12,000 points took quadratic time."""
    at = np.unique(np.random.default_rng(3000).choice(3600, 3000, replace=False))
    assert len(np.unique(network.delaunay(at // 60 / 10, at % 60 / 10))) == 3000
    at = np.random.default_rng(1).choice(1009 * 997, 12_000, replace=False)
    x, y = at // 997 / 10, at % 997 / 10
    began = time.time()
    unw = network.unwrap_points(x, y, mcf.wrap(0.05 * x + 0.04 * y), np.full(12_000, 0.1))
    assert time.time() - began < 15 and np.ptp(unw - 0.05 * x - 0.04 * y) < 1e-6


def test_small_frames_are_many_tasks(spark):
    i, j = np.indices((4, 4))
    p = spark.createDataFrame(pd.concat([pd.DataFrame({"frame_id": str(f), "i": i.ravel(), "j": j.ravel(), "psi": 0.1, "corr": 0.9, "mask": True}) for f in range(60)]))
    for solved in (api.unwrap(p, 5.0), tiled.solved_tiles(p, 4, 4, 5.0, 3, 1, api.Options())):
        assert solved.select(F.spark_partition_id().alias("part")).distinct().count() > 4


def test_frames_of_noise_cost_the_same_with_ground_or_without():
    rng = np.random.default_rng(6)
    for size in ((2, 2), (2, 9), (3, 3), (17, 31)):
        phase = rng.uniform(-np.pi, np.pi, size)
        pick = lambda *s: rng.integers(0, 9, s)
        c = mcf.Costs(pick(size[0], size[1] - 1), pick(size[0], size[1] - 1), pick(size[0] - 1, size[1]), pick(size[0] - 1, size[1]))
        f, supply = mcf.solve(mcf.residues(phase), c), mcf.residues(phase)
        assert (supply[1:-1, 1:-1] + f[0][:-1] + f[1][:, 1:] - f[0][1:] - f[1][:, :-1] == 0).all()
        assert mcf.objective(c, *f) == mcf.objective(c, *network.solve_grounded(supply, c.down, c.up, c.left, c.right))
    assert mcf._table(5.0) is mcf._table(5.0)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_spread_over_join_keys(spark):
    p = raster(spark, np.arange(4000.0).reshape(100, 40), "psi", corr=0.5, mask=True, truth=0.0, unw=1.0)
    e = st.edges(p)
    t = co.slope_guard_threshold(e)
    assert co.guarded(e, t).count() == e.count() and "_part" in _plan(co.guarded(e, t))
    assert st.per_frame(p, spark.createDataFrame([("b", 1)], "frame_id string, x int")).count() == 0
    keys = p.withColumn("_part", F.pmod(F.hash("i", "j", "psi"), F.lit(64))).groupBy("_part").count()
    assert keys.agg(F.max("count")).first()[0] < 4000 / 64 * 2


def test_median_in_cycles(spark):
    rng = random.Random(5)
    rows = []
    for f in range(60):
        size = rng.choice([1, 2, 3, 4, 9, 10])
        rows += [(str(f), rng.choice([rng.uniform(-20, 20), rng.randint(-4, 4) * TAU / 2])) for _ in range(size)]
    rows.append(("0", None))
    df = spark.createDataFrame(rows, "frame_id string, v double")
    want = {r.frame_id: r.m for r in df.groupBy("frame_id").agg(F.rint(F.median("v") / TAU).alias("m")).collect()}
    assert {r.frame_id: r.m for r in fr.median_cycles(df, F.col("v"), TAU, "m").collect()} == want


def test_truth_is_spread_over_join_keys(spark):
    p = raster(spark, np.arange(4000.0).reshape(100, 40), "psi", corr=0.5, mask=True, truth=0.0, unw=1.0)
    errors = tr.ambiguity_errors(p)
    assert errors.count() == 4000 and "_part" in _plan(errors) and "median" not in _plan(errors)

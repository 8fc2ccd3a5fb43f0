"""Result files, tables, lists of inputs, names of outputs, and campaign operators that SQL rows do not cover."""

import json

import pytest
from pyspark.sql import functions as F

from isophase.functions import phase
from isophase.operators import campaign, stencil
from isophase.sources import flat, tables


def test_results(spark, tmp_path):
    for name, rec in (("a/full", {"score": 1.5}), ("a/512", {"score": 2.5, "crop": "own"}), ("b/full", {"score": None, "product": "B"})):
        path = tmp_path / "results" / f"{name}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(rec, indent=1))
    got = {(r["product"], r.crop): (r.score, r.json_path[-10:]) for r in tables.read_results(spark, str(tmp_path)).collect()}
    assert got == {("a", "full"): (1.5, "/full.json"[-10:]), ("a", "own"): (2.5, "a/512.json"), ("B", "full"): (None, "/full.json")}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_results(spark, str(tmp_path / "none"))


def test_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text("track,name\n3,x\n4,\n")
    got = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("track", "int"), ("name", "string")] and [tuple(r) for r in got.collect()] == [(3, "x"), (4, None)]
    assert tables.read_table(spark, str(tmp_path / "t.csv"), "track string, name string").first().track == "3"


def test_inputs(spark):
    files = spark.createDataFrame([("/d/a.h5",), ("/d/b.h5",), ("/da/c.h5",)], "path string")
    entries = lambda *x: spark.createDataFrame(list(enumerate(x)), "nth int, entry string")
    got = tables.resolve_inputs(entries("/d/b.h5", "/d/", "/da/c.h5", "/d/b.h5"), files).orderBy("nth", "path").collect()
    assert [(r.path, r.nth) for r in got] == [("/d/b.h5", 0), ("/d/a.h5", 1), ("/da/c.h5", 2)]
    with pytest.raises(Exception, match="no such input: /none"):
        tables.resolve_inputs(entries("/none"), files).collect()


def test_output_names():
    assert [tables.output_format(x) for x in ("a.TIF", "a.tiff", "a.unw", "a.UNW", "a.bin", "a")] == ["tiff", "tiff", "altline", "altline", "float", "float"]
    assert tables.output_format("a.tif", "float") == "float"
    assert [tables.components_path(x) for x in ("d/a.tif", "d/a.unw", "d/a")] == ["d/a.conncomp.tif", "d/a.unw.conncomp", "d/a.conncomp"]
    assert tables.components_path("d/a.dat", "tiff") == "d/a.conncomp.tif"


def test_parameter_file_takes_the_first_key():
    got = flat.parse_par("range_samp: 5 px\ninterferogram_width: 9\naz_samp:\nnlines: 7\nazimuth_lines: 8")
    assert (got.width, got.rows, got.big_endian) == (5, 7, True)
    with pytest.raises(ValueError):
        flat.parse_par("nlines: 7")


def test_shuffle_usual_and_missing(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None) for i in range(30)], "key int, v int")
    places = [[r.place for r in campaign.shuffled(df, seed, "key").orderBy("key").collect()] for seed in (1, 1, 2)]
    assert places[0] == places[1] != places[2] and sorted(places[0]) == list(range(30))
    assert tuple(campaign.usual(df, "v").first()) == (1, 10)
    there, missing = campaign.with_missing(df, df.where("key < 20").select("key"), "key")
    assert there.count() == 20 and [r.key for r in missing.orderBy("key").collect()] == list(range(20, 30))


@pytest.mark.parametrize("k", [0, 1, 3, 25])
def test_erosion_against_all_distances(spark, k):
    import random

    rng = random.Random(k)
    mask = {(i, j): rng.random() > 0.02 for i in range(23) for j in range(31)}
    df = spark.createDataFrame([("f", i, j, m) for (i, j), m in mask.items()], "frame_id string, i int, j int, mask boolean")
    holes = [p for p, m in mask.items() if not m]
    want = {p for p in mask if all(abs(p[0] - i) + abs(p[1] - j) > k for i, j in holes)}
    assert {(r.i, r.j) for r in stencil.eroded(df, k).where("mask").collect()} == want


def test_open_water_keeps_shores_and_narrow_water(spark):
    code = lambda i, j: 11 if j < 10 else 111 if j < 40 else 11 if j < 45 else 111 if j < 48 else 255 if i == 0 else 10
    df = spark.createDataFrame([("f", i, j, code(i, j) + 256 * 5) for i in range(12) for j in range(50)], "frame_id string, i int, j int, code int")
    got = {(r.i, r.j): r.mask for r in stencil.open_water_mask(df, 4).collect()}
    assert all(got[5, j] for j in (*range(14), *range(36, 48))) and not any(got[5, j] for j in range(14, 36))
    assert not got[0, 49] and not got[5, 49]


def test_crop_and_looks(spark):
    df = spark.createDataFrame([("f", i, j) for i in range(7) for j in range(10)], "frame_id string, i int, j int").withColumn("at", F.col("i") * 10 + F.col("j"))
    got = sorted((r.i, r.j, r.at) for r in stencil.center_crop(df, 4).collect())
    assert got == [(i, j, (i + 1) * 10 + j + 3) for i in range(4) for j in range(4)]
    assert stencil.center_crop(df, "Full").count() == 70
    with pytest.raises(Exception, match="larger than frame f"):
        stencil.center_crop(df, 8).collect()
    one = spark.range(1).select(*(phase.nominal_looks(F.lit(13), F.lit(16), F.lit(b), F.lit(1.5), F.lit(0.0006), F.lit(1200.0)).alias(n) for n, b in (("x", 77e6), ("bad", -1.0)))).first()
    assert abs(one.x - 208 / ((299792458 / 154e6 / 1.5) * (1 / 0.0006 / 1200))) < 1e-9 and one.bad is None


def test_multilook_rules(spark):
    """Blocks under half valid are zero; zero pixels are not valid."""
    px = [("f", i, j, 1.0 if (i, j) != (0, 3) else 0.0, 0.0, 0.5, not (i < 2 and j < 2 and i + j < 2)) for i in range(4) for j in range(5)]
    df = spark.createDataFrame(px, "frame_id string, i int, j int, re double, im double, corr double, mask boolean")
    got = {(r.i, r.j): (r.re, r.corr, r.mask) for r in stencil.multilook(df, 2).collect()}
    assert got == {(0, 0): (0.0, 0.0, False), (0, 1): (1.0, 0.5, True), (1, 0): (1.0, 0.5, True), (1, 1): (1.0, 0.5, True)}


def test_frame_residues_skip_masked_ends(spark):
    px = [("f", 0, j, 3.0 * (-1) ** j, j != 1) for j in range(4)] + [("f", 1, j, 0.0, True) for j in range(4)]
    df = spark.createDataFrame(px, "frame_id string, i int, j int, psi double, mask boolean")
    top = [r["at"] for r in stencil.frame_deposits(df).where("side = 'top'").collect()]
    assert top == [3]

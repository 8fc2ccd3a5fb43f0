"""The closure queries over every day of ``events``."""

import datetime
import math

import duckdb
import pytest

from isophase import registry
from isophase.plans import rasters


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_no_event_is_out_of_the_stack(folder):
    day = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    got = duckdb.sql(f"SELECT min({day}), max({day}) FROM '/root/testdata/{folder}/events.parquet'").fetchall()
    assert got == [(0, rasters.DAYS - 1)]


def test_a_misclosure_of_late_days_counts(spark, tmp_path):
    # one user, days 20 to 22, phases 0, 2.5 and 5: the triangle misses closure by a cycle
    rows = [(1, datetime.datetime(2024, 1, 21 + d), 2.5 * d) for d in range(3)] + [(2, datetime.datetime(2024, 1, 30), 0.5)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    q = registry.queries()
    theta = [0.0] * 20 + [0.0, 2.5, 5.0] + [0.0] * 7
    wrap = lambda x: x - math.tau * round(x / math.tau)
    want = max(abs(round((wrap(theta[a + 1] - theta[a]) + wrap(theta[a + 2] - theta[a + 1]) - wrap(theta[a + 2] - theta[a])) / math.tau)) for a in range(28))
    assert want == 1
    assert {r.i: r.quality for r in q["triangle_quality"](spark, str(tmp_path)).collect()} == {1: want, 2: 0}
    assert {r.i: r.quality > 0 for r in q["closure_quality"](spark, str(tmp_path)).collect()} == {1: True, 2: False}
    k = q["closure_correct"](spark, str(tmp_path))
    assert k.count() == 2 * 57 and {r.i for r in k.where("k <> 0").collect()} == {1}
    assert {r.i: r.iterations > 0 for r in q["closure_refine"](spark, str(tmp_path)).collect()} == {1: True, 2: False}

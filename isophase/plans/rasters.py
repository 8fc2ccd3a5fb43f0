"""Rasters, stacks and campaign tables derived from the relational test tables, for the registered queries.

The same derivations stand in :data:`CTE` as DuckDB SQL. All sums are over integers, so that both engines get the same
bits whatever order they add in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isophase.functions.phase import wrap
from isophase.operators.closure import TemporalGraph

#: Pixels in a row of the derived raster; the noise put on its ramp (cycles appear from about 3 on); looks.
WIDTH, NOISE, LOOKS = 125, 5.5, 5.0
#: Days of ``events``, from 2024-01-01 on.
DAYS = 30
TAU = "6.283185307179586"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_id, i, j, psi, corr, mask, variance)``: one pixel per order, wrapped noisy ramp."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    p = o.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    i, j = F.floor(F.col("o_orderkey") / WIDTH).cast("int"), (F.col("o_orderkey") % WIDTH).cast("int")
    p = p.select(F.lit("orders").alias("frame_id"), i.alias("i"), j.alias("j"), "o_totalprice", "o_orderstatus", "d", "n", "q")
    x = 0.35 * (F.col("i") + F.col("j")) + (F.col("o_totalprice") - F.floor(F.col("o_totalprice") / 1000) * 1000) / 1000 * NOISE
    corr = F.coalesce(1 - F.col("d") / F.col("n") * 0.09, F.lit(0.0))
    return p.select(
        "frame_id", "i", "j", wrap(x).alias("psi"), corr.alias("corr"), ((F.col("o_orderstatus") != "P") & F.col("n").isNotNull()).alias("mask"), (F.col("q") / F.col("n") / 20).alias("variance")
    )


def day_pairs(days: int) -> TemporalGraph:
    """Interferograms between days one and two apart."""
    return TemporalGraph(days, tuple((a, b) for a in range(days) for b in (a + 1, a + 2) if b < days))


def event_stack(spark: SparkSession, sf_dir: str, graph: TemporalGraph) -> DataFrame:
    """``(e, from_date, to_date, i, j, unw)``: the interferograms of ``graph``, one pixel per user.

    The phase of a user and day is the sum of the user's values that day, a day without events being zero; it is
    wrapped in each interferogram.
    """
    ev = _table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    value = F.sum(F.round(F.col("value") * 1000).cast("long")) / 1000
    per = ev.groupBy("user_id", day.alias("day")).agg(value.alias("theta")).where(F.col("day").between(0, graph.n_dates - 1))
    users = ev.select("user_id").distinct()
    edges = spark.createDataFrame([(e, a, b) for e, (a, b) in enumerate(graph.edges)], "e int, from_date int, to_date int")
    at = lambda d, name: per.select(F.col("user_id").alias(f"u_{name}"), F.col("day").alias(d), F.col("theta").alias(name))
    s = users.crossJoin(edges)
    for d, name in (("from_date", "a"), ("to_date", "b")):
        o = at(f"d_{name}", name)
        s = s.join(o, (F.col("user_id") == F.col(f"u_{name}")) & (F.col(d) == F.col(f"d_{name}")), "left")
    unw = wrap(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)))
    return s.select("e", "from_date", "to_date", F.col("user_id").alias("i"), F.lit(0).alias("j"), unw.alias("unw"))


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, track, frame, direction, score, runtime_s, num_pixels, peak_rss_mb)`` from customers."""
    c = _table(spark, sf_dir, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    return c.select(
        F.col("c_name").alias("key"), F.col("c_nationkey").alias("track"), (F.col("c_custkey") % 50).cast("int").alias("frame"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("D").alias("direction"),
        (1 - F.pmod(cents, F.lit(2000)) / 10000).alias("score"), (F.pmod(cents, F.lit(30000)) / 100).alias("runtime_s"), (1000000 + F.pmod(cents, F.lit(7)) * 250000).alias("num_pixels"), (512 + F.pmod(cents, F.lit(11)) * 128).alias("peak_rss_mb"),
    )


#: DuckDB forms of the derivations above.
CTE = {
    "pix": f"""
 items AS (SELECT l_orderkey, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1),
 raw AS (SELECT 'orders' AS frame_id, CAST(floor(o_orderkey / {WIDTH}.0) AS INT) AS i, CAST(o_orderkey % {WIDTH} AS INT) AS j, o_totalprice AS t, o_orderstatus AS s, CAST(d AS BIGINT) AS d, n, CAST(q AS BIGINT) AS q FROM orders LEFT JOIN items ON o_orderkey = l_orderkey),
 ramp AS (SELECT *, CAST(0.35 AS DOUBLE) * (i + j) + (t - floor(t / 1000) * 1000) / 1000 * CAST({NOISE} AS DOUBLE) AS x FROM raw),
 pix AS (SELECT frame_id, i, j, x - CAST({TAU} AS DOUBLE) * round(x / CAST({TAU} AS DOUBLE)) AS psi, coalesce(1 - CAST(d AS DOUBLE) / n * CAST(0.09 AS DOUBLE), 0) AS corr, (s <> 'P' AND n IS NOT NULL) AS mask, CAST(q AS DOUBLE) / n / 20 AS variance FROM ramp)""",
    "stack": f"""
 per AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, sum(CAST(round(value * 1000) AS BIGINT)) / CAST(1000 AS DOUBLE) AS theta FROM events GROUP BY 1, 2),
 pairs AS (SELECT a, a + g AS b, CAST(row_number() OVER (ORDER BY a, g) - 1 AS INT) AS e FROM range({DAYS}) t(a), (VALUES (1), (2)) v(g) WHERE a + g < {DAYS}),
 stack AS (SELECT e, CAST(a AS INT) AS from_date, CAST(b AS INT) AS to_date, user_id AS i, 0 AS j, w - CAST({TAU} AS DOUBLE) * round(w / CAST({TAU} AS DOUBLE)) AS unw FROM (
   SELECT e, a, b, u.user_id, coalesce(pb.theta, 0) - coalesce(pa.theta, 0) AS w FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN pairs LEFT JOIN per pa ON pa.user_id = u.user_id AND pa.day = a LEFT JOIN per pb ON pb.user_id = u.user_id AND pb.day = b))""",
    "camp": """
 cents AS (SELECT *, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer),
 camp AS (SELECT c_name AS key, c_nationkey AS track, CAST(c_custkey % 50 AS INT) AS frame, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'D' END AS direction,
   1 - CAST(((c % 2000) + 2000) % 2000 AS DOUBLE) / 10000 AS score, CAST(((c % 30000) + 30000) % 30000 AS DOUBLE) / 100 AS runtime_s, 1000000 + ((c % 7) + 7) % 7 * 250000 AS num_pixels, 512 + ((c % 11) + 11) % 11 * 128 AS peak_rss_mb FROM cents)""",
}


def sql(body: str, *names: str) -> str:
    return "WITH " + ",".join(CTE[n] for n in names) + "\n" + body

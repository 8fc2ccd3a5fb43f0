"""Named queries of the raster and campaign operators, and the DuckDB SQL that each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isophase import api
from isophase.functions import phase as ph
from isophase.operators import campaign as ca
from isophase.operators import closure as cl
from isophase.operators import costs as co
from isophase.operators import frames as fr
from isophase.operators import stencil as st
from isophase.operators import truth as tr
from isophase.plans import tiled
from isophase.plans.rasters import CTE, DAYS, LOOKS, TAU, WIDTH, campaign, day_pairs, event_stack, orders_raster, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(oracle: str | None = None, *ctes: str):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = sql(oracle, *ctes) if ctes else oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})


_D = "CAST({} AS DOUBLE)"
_CYC = f"CAST(round(({{}}) / {_D.format(TAU)}) AS INT)"
_NEIGH = """, n4 AS (SELECT p.*, r.psi AS rp, r.mask AS rm, r.corr AS rc, r.variance AS rv, d.psi AS dp, d.mask AS dm, d.corr AS dc, d.variance AS dv, x.psi AS xp, x.mask AS xm FROM pix p
 LEFT JOIN pix r ON r.i = p.i AND r.j = p.j + 1 LEFT JOIN pix d ON d.i = p.i + 1 AND d.j = p.j LEFT JOIN pix x ON x.i = p.i + 1 AND x.j = p.j + 1)"""


def _neigh(body: str) -> str:
    return "WITH " + CTE["pix"] + _NEIGH + "\n" + body


def _wrap(x: str) -> str:
    return f"(({x}) - {_D.format(TAU)} * round(({x}) / {_D.format(TAU)}))"


_CURL = " + ".join(_CYC.format(x) for x in ("psi - rp", "rp - xp", "xp - dp", "dp - psi"))


@_query(_neigh(f"SELECT frame_id, i + 1 AS i, j + 1 AS j, charge FROM (SELECT *, {_CURL} AS charge FROM n4 WHERE mask AND rm AND dm AND xm) WHERE charge <> 0"))
def residues_interior(spark, sf_dir):
    return st.residues(orders_raster(spark, sf_dir))


_ALL_SIDES = " UNION ALL ".join(
    f"SELECT frame_id, '{side}' AS side, {at} + 1 AS at, {sign}{_CYC.format(f'psi - {q}')} AS charge, mask AND {q[0]}m AS both_ FROM n4 WHERE {where} AND {q} IS NOT NULL"
    for side, where, at, q, sign in (("top", "i = 0", "j", "rp", "-"), ("bottom", "i = (SELECT max(i) FROM pix)", "j", "rp", ""), ("left", "j = 0", "i", "dp", ""), ("right", "j = (SELECT max(j) FROM pix)", "i", "dp", "-"))
)


@_query(_neigh(f"SELECT * EXCLUDE (both_) FROM ({_ALL_SIDES}) WHERE charge <> 0 AND both_"))
def residues_frame(spark, sf_dir):
    return st.frame_deposits(orders_raster(spark, sf_dir))


@_query(_neigh(f"SELECT 'orders' AS frame_id, CAST((SELECT sum({_CURL}) FROM n4 WHERE xp IS NOT NULL) + (SELECT sum(charge) FROM ({_ALL_SIDES})) AS BIGINT) AS total"))
def residue_balance(spark, sf_dir):
    p = orders_raster(spark, sf_dir).withColumn("mask", F.lit(True))
    both = st.residues(p).select("frame_id", "charge").unionByName(st.frame_deposits(p).select("frame_id", "charge"))
    return both.groupBy("frame_id").agg(F.sum("charge").alias("total"))


_EDGES = f"""SELECT frame_id, 'h' AS dir, i, j, {_wrap('rp - psi')} AS gradient, least(corr, rc) AS corr, mask AND rm AS both, NOT mask AND NOT rm AS none, variance AS va, rv AS vb FROM n4 WHERE rp IS NOT NULL
 UNION ALL SELECT frame_id, 'v', i, j, {_wrap('dp - psi')}, least(corr, dc), mask AND dm, NOT mask AND NOT dm, variance, dv FROM n4 WHERE dp IS NOT NULL"""


@_query(_neigh(f'SELECT frame_id, dir, i, j, round(gradient, 6) + 0.0 AS gradient, round(corr, 6) AS corr, "both", "none" FROM ({_EDGES})'))
def edge_gradients(spark, sf_dir):
    return _round(st.edges(orders_raster(spark, sf_dir)), 6, "gradient", "corr")


_GUARD = f"""e AS ({_EDGES}), h AS (SELECT least(CAST(floor(abs(gradient) / {_D.format('3.141592653589793')} * 1024) AS INT), 1023) AS bin, count(*) AS n FROM e WHERE "both" AND corr > 1e-9 GROUP BY 1),
 w AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS acc, sum(n) OVER () AS total FROM h),
 g AS (SELECT 'orders' AS frame_id, greatest(CAST(1.0 AS DOUBLE), coalesce((max(bin) FILTER (WHERE acc > floor(total * CAST(0.03 AS DOUBLE))) + 1) / {_D.format('1024')} * {_D.format('3.141592653589793')}, {_D.format('3.141592653589793')})) AS threshold FROM w)"""


@_query("WITH " + CTE["pix"] + _NEIGH + ", " + _GUARD + " SELECT frame_id, round(threshold, 9) AS threshold FROM g")
def slope_guard_threshold(spark, sf_dir):
    return _round(co.slope_guard_threshold(st.edges(orders_raster(spark, sf_dir))), 9, "threshold")


@_query("WITH " + CTE["pix"] + _NEIGH + ", " + _GUARD + ' SELECT dir, count(*) AS n, CAST(sum(CASE WHEN "both" AND corr > 1e-9 AND abs(gradient) >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_guarded FROM e, g GROUP BY dir')
def slope_guard_hits(spark, sf_dir):
    e = st.edges(orders_raster(spark, sf_dir))
    g = co.guarded(e, co.slope_guard_threshold(e))
    return g.groupBy("dir").agg(F.count("*").alias("n"), F.sum(F.col("guard").cast("long")).alias("n_guarded"))


_VAR = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN CAST(50 AS DOUBLE) ELSE greatest(least({0}, 50), CAST(0.001 AS DOUBLE)) END"


def _edge_variances(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    e = st.edges(p)
    v = p.select("frame_id", "i", "j", "variance")
    di, dj = (F.col("dir") == "v").cast("int"), (F.col("dir") == "h").cast("int")
    e = e.join(v.withColumnRenamed("variance", "va"), ["frame_id", "i", "j"])
    e = e.withColumn("qi", F.col("i") + di).withColumn("qj", F.col("j") + dj)
    return e.join(v.select("frame_id", F.col("i").alias("qi"), F.col("j").alias("qj"), F.col("variance").alias("vb")), ["frame_id", "qi", "qj"]).drop("qi", "qj")


_W = f"(1 / ({_VAR.format('va')} + {_VAR.format('vb')}))"
_PI = _D.format("3.141592653589793")


@_query(_neigh(f"SELECT frame_id, dir, i, j, CAST(least(round(100 * greatest({_W} * ({_PI} - 1 * gradient), 0)), 65535) AS INT) AS cost_plus, CAST(least(round(100 * greatest({_W} * ({_PI} - -1 * gradient), 0)), 65535) AS INT) AS cost_minus FROM ({_EDGES})"))
def crlb_arc_costs(spark, sf_dir):
    return co.crlb_costs(_edge_variances(spark, sf_dir)).select("frame_id", "dir", "i", "j", "cost_plus", "cost_minus")


@_query(
    "WITH " + CTE["pix"] + """, r AS (SELECT i, min(j) AS a, max(j) AS b FROM pix GROUP BY 1), c AS (SELECT j, min(i) AS a, max(i) AS b FROM pix GROUP BY 1),
 w AS (SELECT p.i, p.j, avg(q.corr) AS w FROM pix p JOIN r USING (i) CROSS JOIN range(-3, 4) o(k) JOIN pix q ON q.i = p.i AND q.j = greatest(least(p.j + k, b), a) GROUP BY 1, 2)
 SELECT p.i, p.j, round(avg(q.w), 6) AS v FROM w p JOIN c USING (j) CROSS JOIN range(-3, 4) o(k) JOIN w q ON q.j = p.j AND q.i = greatest(least(p.i + k, b), a) GROUP BY 1, 2"""
)
def box_smooth(spark, sf_dir):
    p = orders_raster(spark, sf_dir).select("frame_id", "i", "j", F.col("corr").alias("v"))
    return _round(st.box_filter(p, 7, 7).select("i", "j", "v"), 6, "v")


@_query("SELECT i, j FROM pix p WHERE NOT EXISTS (SELECT 1 FROM pix q WHERE NOT q.mask AND q.i BETWEEN p.i - 2 AND p.i + 2 AND abs(q.i - p.i) + abs(q.j - p.j) <= 2)", "pix")
def mask_erosion(spark, sf_dir):
    return st.eroded(orders_raster(spark, sf_dir), 2).where("mask").select("i", "j")


_CODES = "SELECT DISTINCT CAST(o_orderkey % 256 AS INT) AS code FROM orders"


@_query(f"SELECT code, code <> 255 AND (code // 10) % 10 > 0 AND code % 10 > 0 AS subswath, code <> 255 AND (code // 100) % 10 = 0 AS water_only, code <> 255 AND (code // 100) % 10 = 0 AND (code // 10) % 10 > 0 AND code % 10 > 0 AS both_, code <> 255 AND (code // 100) % 10 > 0 AS water FROM ({_CODES})")
def mask_policy(spark, sf_dir):
    c = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 256).cast("int").alias("code")).distinct()
    code = F.col("code")
    return c.select("code", ph.mask_policy(code, "subswath").alias("subswath"), ph.mask_policy(code, "water_only").alias("water_only"), ph.mask_policy(code, "water_and_subswath").alias("both_"), ph.water_mask(code).alias("water"))


_LK = "FILTER (WHERE mask AND re <> 0)"


@_query(
    f"SELECT i, j, round(CASE WHEN half THEN sc / CAST(n AS DOUBLE) ELSE 0 END, 6) + 0.0 AS corr, half AS mask, round(CASE WHEN half AND sr * sr + n * n > 0 THEN sr / sqrt(sr * sr + n * n) ELSE 0 END, 6) + 0.0 AS re FROM (SELECT CAST(i // 5 AS INT) AS i, CAST(j // 5 AS INT) AS j, sum(corr) {_LK} AS sc, sum(re) {_LK} AS sr, count(*) {_LK} AS n, 2 * count(*) {_LK} >= 25 AS half FROM (SELECT i, j, mask, floor(psi * 1000) AS re, floor(corr * 10000) AS corr FROM pix) WHERE i // 5 < (SELECT max(i) + 1 FROM pix) // 5 GROUP BY 1, 2)",
    "pix",
)
def multilook(spark, sf_dir):
    whole = lambda c, f: F.floor(F.col(c) * f).cast("double")  # noqa: E731 - sums of whole numbers are the same in any order
    p = orders_raster(spark, sf_dir).withColumn("re", whole("psi", 1000)).withColumn("corr", whole("corr", 10000)).withColumn("im", F.when(F.col("re") != 0, F.lit(1.0)).otherwise(0.0))
    return _round(st.multilook(p, 5), 6, "corr", "re").select("i", "j", "corr", "mask", "re")


@_query("WITH " + CTE["pix"] + ", w AS (SELECT i, j, CAST((i * 125 + j) * 7 % 223 AS INT) AS code FROM pix) SELECT i, j, code // 10 % 10 > 0 AND code % 10 > 0 AND NOT (code // 100 <> 0 AND NOT EXISTS (SELECT 1 FROM w q WHERE q.code // 100 = 0 AND abs(q.i - p.i) + abs(q.j - p.j) <= 1)) AS mask FROM w p")
def open_water(spark, sf_dir):
    p = orders_raster(spark, sf_dir).select("frame_id", "i", "j", ((F.col("i") * 125 + F.col("j")) * 7 % 223).cast("int").alias("code"))
    return st.open_water_mask(p, 1).select("i", "j", "mask")


@_query("SELECT i - (max(i) OVER () + 1 - 10) // 2 AS i, j - 57 AS j, mask FROM pix QUALIFY i - (max(i) OVER () + 1 - 10) // 2 BETWEEN 0 AND 9 AND j - 57 BETWEEN 0 AND 9", "pix")
def center_crop(spark, sf_dir):
    return st.center_crop(orders_raster(spark, sf_dir), 10).select("i", "j", "mask")


_STEP = f"CAST(-round((psi - {{}}) / {_D.format(TAU)}) AS INT)"


@_query(
    f"SELECT frame_id, i, j, CAST(k0 + sum(sh) OVER (PARTITION BY i ORDER BY j) AS INT) AS k FROM (SELECT frame_id, i, j, CASE WHEN j > 0 THEN {_STEP.format('lag(psi) OVER (PARTITION BY i ORDER BY j)')} ELSE 0 END AS sh FROM pix) JOIN (SELECT i, sum(coalesce({_STEP.format('lag(psi) OVER (ORDER BY i)')}, 0)) OVER (ORDER BY i) AS k0 FROM (SELECT i, psi FROM pix WHERE j = 0) ) USING (i)".replace(
        f"sum(coalesce({_STEP.format('lag(psi) OVER (ORDER BY i)')}, 0)) OVER (ORDER BY i) AS k0 FROM (SELECT i, psi FROM pix WHERE j = 0) ", f"sum(sv) OVER (ORDER BY i) AS k0 FROM (SELECT i, coalesce({_STEP.format('lag(psi) OVER (ORDER BY i)')}, 0) AS sv FROM pix WHERE j = 0)"
    ),
    "pix",
)
def integrate_itoh(spark, sf_dir):
    return st.itoh(orders_raster(spark, sf_dir)).select("frame_id", "i", "j", "k")


@_query(f"SELECT i, j, round(CASE WHEN mask THEN psi + {_D.format(TAU)} * round_even((3 * psi + i * CAST(0.1 AS DOUBLE) - psi) / {_D.format(TAU)}, 0) ELSE 0 END, 6) + 0.0 AS unw FROM pix", "pix")
def k_transfer(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    unw = ph.transferred(F.col("psi"), 3 * F.col("psi") + F.col("i") * 0.1, F.col("mask"))
    return _round(p.select("i", "j", unw.alias("unw")), 6, "unw")


@_query("SELECT i, j, round(CASE WHEN variance > 0 THEN 1 / sqrt(1 + 2 * variance) ELSE 0 END, 9) AS pseudo, round(2 * 5 * g * g / (1 - g * g), 6) AS reliability FROM (SELECT *, greatest(least(corr, CAST(0.999 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS g FROM pix)", "pix")
def pixel_reliability(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    out = p.select("i", "j", ph.pseudo_coherence(F.col("variance")).alias("pseudo"), ph.coherence_reliability(F.col("corr"), LOOKS).alias("reliability"))
    return _round(_round(out, 9, "pseudo"), 6, "reliability")


@_query("SELECT count(*) AS n, count(*) FILTER (WHERE corr < -1e-4 OR corr > 1.0001) AS n_bad, count(*) FILTER (WHERE mask) AS n_valid FROM pix", "pix")
def coherence_check(spark, sf_dir):
    bad = ~ph.finite(F.col("corr")) | (F.col("corr") < -1e-4) | (F.col("corr") > 1.0001)
    return orders_raster(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("n_bad"), F.sum(F.col("mask").cast("long")).alias("n_valid"))


def _labels(spark, sf_dir):
    """Stand-in components: bands of the raster where it is valid."""
    p = orders_raster(spark, sf_dir)
    return p.select("frame_id", "i", "j", "psi", "corr", "mask", F.when(F.col("mask"), F.floor(F.col("j") / 10) % 4 + 1 + F.when(F.col("j") >= 110, 4).otherwise(0)).otherwise(0).cast("int").alias("label"))


_LABELS = "labels_ AS (SELECT frame_id, i, j, psi, corr, mask, CAST(CASE WHEN mask THEN (j // 10) % 4 + 1 + CASE WHEN j >= 110 THEN 4 ELSE 0 END ELSE 0 END AS INT) AS label FROM pix)"


@_query("WITH " + CTE["pix"] + ", " + _LABELS + ", s AS (SELECT label, count(*) AS n, min(i * 125 + j) AS f FROM labels_ WHERE label > 0 GROUP BY 1), r AS (SELECT label, row_number() OVER (ORDER BY n DESC, f) AS nw FROM s WHERE n >= greatest(100, ceil(0.05 * (SELECT sum(n) FROM s)))) SELECT i, j, CAST(CASE WHEN nw <= 4 THEN nw ELSE 0 END AS INT) AS label FROM labels_ LEFT JOIN r USING (label)")
def label_finalize(spark, sf_dir):
    return fr.finalize_labels(_labels(spark, sf_dir).select("frame_id", "i", "j", "label"), 100, 0.05, 4).select("i", "j", "label")


@_query("WITH " + CTE["pix"] + ", " + _LABELS + ", s AS (SELECT label, count(*) AS n FROM labels_ GROUP BY 1) SELECT 'orders' AS frame_id, count(*) FILTER (WHERE label > 0) AS n_components, round(max(n) FILTER (WHERE label > 0) / CAST(sum(n) AS DOUBLE), 9) AS largest_fraction, round(CAST(sum(n) FILTER (WHERE label > 0) AS DOUBLE) / sum(n), 9) AS labelled_fraction FROM s")
def component_summary(spark, sf_dir):
    return _round(fr.component_summary(_labels(spark, sf_dir)), 9, "largest_fraction", "labelled_fraction")


@_query(
    "WITH " + CTE["pix"] + ", " + _LABELS + ", b AS (SELECT p.label, p.i, p.j FROM labels_ p WHERE label > 0 AND EXISTS (SELECT 1 FROM labels_ q WHERE q.label <> p.label AND ((q.i = p.i AND q.j = p.j + 1) OR (q.i = p.i AND q.j = p.j - 1) OR (q.i = p.i + 1 AND q.j = p.j) OR (q.i = p.i - 1 AND q.j = p.j)))), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY i, j) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM b) SELECT label, i, j, CAST(rank AS INT) AS rank FROM r WHERE rank % CAST(ceil(n / CAST(200 AS DOUBLE)) AS BIGINT) = 0"
)
def boundary_pixels(spark, sf_dir):
    return st.boundary_pixels(_labels(spark, sf_dir).select("frame_id", "i", "j", "label"), 200).select("label", "i", "j", F.col("rank").cast("int").alias("rank"))


_TILES = "SELECT k AS t, least(k * 40, greatest(n - 50, 0)) AS s0 FROM (SELECT n, unnest(range(greatest(CAST(ceil((n - 50) / 40.0) AS BIGINT), 0) + 1)) AS k FROM (SELECT {} AS n))"


@_query(f"SELECT CAST(r.t AS INT) AS tile_r, CAST(c.t AS INT) AS tile_c, count(*) AS n, CAST(sum(i * 125 + j) AS BIGINT) AS s FROM pix JOIN ({_TILES.format('(SELECT max(i) + 1 FROM pix)')}) r ON i BETWEEN r.s0 AND r.s0 + 49 JOIN ({_TILES.format(WIDTH)}) c ON j BETWEEN c.s0 AND c.s0 + 49 GROUP BY 1, 2", "pix")
def tile_decompose(spark, sf_dir):
    p = orders_raster(spark, sf_dir).select("frame_id", F.col("i").alias("i0"), F.col("j").alias("j0"), "i", "j")
    rows = p.agg(F.max("i")).first()[0] + 1  # the raster's height, known from its metadata outside of tests
    d = fr.decomposed(p, rows, WIDTH, 50, 10)
    return d.groupBy("tile_r", "tile_c").agg(F.count("*").alias("n"), F.sum((F.col("i0") * WIDTH + F.col("j0")).cast("long")).alias("s"))


@_query(f"SELECT tile, k, CAST(round(w) AS BIGINT) AS confidence FROM (SELECT tile, k, w, row_number() OVER (PARTITION BY tile ORDER BY round(w, 9) DESC, abs(k), k) AS n FROM (SELECT tile, k, sum(w) AS w FROM (SELECT j // 25 AS tile, CAST(round((psi * 2 + i % 7 * CAST(0.9 AS DOUBLE) - psi) / {_D.format(TAU)}) AS BIGINT) AS k, CASE WHEN corr > 0 THEN corr * corr ELSE CAST(0.001 AS DOUBLE) END AS w FROM pix) GROUP BY 1, 2)) WHERE n = 1", "pix")
def stitch_offset_mode(spark, sf_dir):
    p = orders_raster(spark, sf_dir).select(F.floor(F.col("j") / 25).cast("int").alias("tile"), F.col("psi").alias("a"), (F.col("psi") * 2 + F.col("i") % 7 * 0.9).alias("b"), "corr")
    return fr.stitching_offsets(p, ["tile"])


@_query(f"WITH {CTE['pix']}, t AS (SELECT i, j, psi + s AS v, w FROM pix, (VALUES (CAST(0 AS DOUBLE), CAST(2 AS DOUBLE)), (CAST(0.5 AS DOUBLE), CAST(1 AS DOUBLE)), (CAST(6 AS DOUBLE), CAST(1.5 AS DOUBLE))) o(s, w)), b AS (SELECT i, j, arg_max(v, w) AS best FROM t GROUP BY 1, 2) SELECT i, j, round(sum(v * w) / sum(w), 6) + 0.0 AS v FROM t JOIN b USING (i, j) WHERE abs(v - best) <= {_PI} GROUP BY 1, 2")
def feather_composite(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    tiles = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in ((0.0, 2.0), (0.5, 1.0), (6.0, 1.5)))))
    t = p.select("frame_id", "i", "j", "psi", tiles.alias("t")).select("frame_id", "i", "j", (F.col("psi") + F.col("t.s")).alias("v"), F.col("t.w").alias("w"))
    return _round(fr.feathered(t).select("i", "j", "v"), 6, "v")


@_query(_neigh(f"SELECT frame_id, round(sum(abs(flow) * corr) / (SELECT count(*) FROM pix WHERE mask), 9) AS rate FROM (SELECT *, CAST(round(gradient) AS INT) AS flow FROM ({_EDGES})) WHERE corr > CAST(0.7 AS DOUBLE) GROUP BY 1"))
def coherent_cut_rate(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    cuts = st.edges(p).withColumn("flow", F.round("gradient").cast("int"))
    n = p.where("mask").groupBy("frame_id").agg(F.count("*").alias("n"))
    rate = fr.coherent_cut_rate(cuts, 1).join(n, "frame_id")
    return rate.select("frame_id", F.round(F.col("rate") / F.col("n"), 9).alias("rate"))


_ALL = day_pairs(DAYS)


def _signs(rows: list[tuple[int, int, int]], name: str) -> str:
    return f"{name}(c, e, s) AS (VALUES {', '.join(map(str, rows))})"


@_query("WITH " + CTE["stack"] + ", " + _signs(_ALL.cycles(), "loops") + f" SELECT i, CAST(max(abs(k)) AS INT) AS quality FROM (SELECT i, c, round(sum(s * unw) / {_D.format(TAU)}) AS k FROM stack JOIN loops USING (e) GROUP BY 1, 2) GROUP BY 1")
def closure_quality(spark, sf_dir):
    return cl.cycle_quality(event_stack(spark, sf_dir, _ALL), _ALL).select("i", "quality")


@_query("WITH " + CTE["stack"] + ", " + _signs(_ALL.triangles(), "loops") + f" SELECT i, CAST(max(abs(k)) AS INT) AS quality FROM (SELECT i, c, round(sum(s * unw) / {_D.format(TAU)}) AS k FROM stack JOIN loops USING (e) GROUP BY 1, 2) GROUP BY 1")
def triangle_quality(spark, sf_dir):
    return cl.triangle_quality(event_stack(spark, sf_dir, _ALL), _ALL).select("i", "quality")


def _along(graph: cl.TemporalGraph) -> str:
    tree = graph.spanning_tree()
    used = {e for _, e, _ in tree.values()}
    path = {(d, e): s for d, e, s in graph.paths()}
    rows = [(x, e, s) for x, (a, b) in enumerate(graph.edges) if x not in used for e in range(len(graph.edges)) if (s := path.get((b, e), 0) - path.get((a, e), 0))]
    return f"along(x, e, s) AS (VALUES {', '.join(map(str, rows))})"


@_query("WITH " + CTE["stack"] + ", " + _along(_ALL) + f", p AS (SELECT x AS e, i, sum(s * unw) AS p FROM stack JOIN along USING (e) GROUP BY 1, 2) SELECT e, i, coalesce(CAST(round((unw - p) / {_D.format(TAU)}) AS INT), 0) AS k, round(unw - {_D.format(TAU)} * coalesce(round((unw - p) / {_D.format(TAU)}), 0), 6) + 0.0 AS corrected FROM stack LEFT JOIN p USING (e, i)")
def closure_correct(spark, sf_dir):
    return _round(cl.closure_correct(event_stack(spark, sf_dir, _ALL), _ALL).select("e", "i", "k", "corrected"), 6, "corrected")


@_query()
def closure_refine(spark, sf_dir):
    s = event_stack(spark, sf_dir, _ALL)
    crlb = s.select("e", "i", "j", (1 + F.pmod(F.xxhash64("e", "i"), F.lit(100)) / 100).alias("variance"))
    out = cl.closure_refine(s, _ALL, crlb)
    return out.select("i", "violations", "iterations")


_K_ERROR = "CAST(CASE WHEN i % 7 = from_date % 7 THEN 1 ELSE 0 END AS INT)"


@_query(
    "WITH " + CTE["stack"] + f""", s AS (SELECT from_date, to_date, i, unw AS psi, {_K_ERROR} AS k FROM stack),
 t AS (SELECT CAST(d AS INT) AS a, CAST(d + 1 AS INT) AS b, CAST(d + 2 AS INT) AS c FROM range({DAYS} - 2) r(d)),
 p AS (SELECT a, b, c, x.i, x.psi + y.psi - z.psi AS psi, x.k + y.k - z.k AS k, x.k <> 0 OR y.k <> 0 OR z.k <> 0 AS wrong FROM t JOIN s x ON x.from_date = a AND x.to_date = b JOIN s y ON y.from_date = b AND y.to_date = c AND y.i = x.i JOIN s z ON z.from_date = a AND z.to_date = c AND z.i = x.i WHERE x.i % 11 <> 0),
 m AS (SELECT *, psi - {_D.format(TAU)} * round(psi / {_D.format(TAU)}) AS mis FROM p)
 SELECT a, b, c, count(*) AS n, round(100 * avg(CAST(round((psi + k * {_D.format(TAU)} - mis) / {_D.format(TAU)}) <> 0 AS INT)), 6) AS pct_k_closure, round(100 * avg(CAST(wrong AS INT)), 6) AS pct_true_any, round(quantile_cont(abs(mis), 0.95), 6) + 0.0 AS wrapped_p95 FROM m GROUP BY 1, 2, 3"""
)
def triplet_closure(spark, sf_dir):
    s = event_stack(spark, sf_dir, _ALL).withColumn("psi", F.col("unw")).withColumn("k_error", F.expr(_K_ERROR))
    unw = F.when((F.col("i") % 11 != 0) | (F.col("to_date") - F.col("from_date") != 2), F.col("psi") + F.lit(float(TAU)) * F.col("k_error")).otherwise(F.lit(float("nan")))
    out = cl.triplet_closure(s.withColumn("unw", unw), DAYS, "short")
    return _round(out, 6, "pct_k_closure", "pct_true_any", "wrapped_p95")


def _products(spark, sf_dir):
    p = _labels(spark, sf_dir)
    prod = F.col("psi") + F.lit(float(TAU)) * F.floor(F.col("j") / 20)
    ww = prod + F.lit(float(TAU)) * (F.col("label") % 3) + F.lit(float(TAU)) * 2
    return p.withColumn("prod_unw", prod).withColumn("ww_unw", ww).withColumn("prod_cc", F.col("label"))


_PROD = "WITH " + CTE["pix"] + ", " + _LABELS + f", prod AS (SELECT *, psi + {_D.format(TAU)} * (j // 20) AS prod_unw, label AS prod_cc FROM labels_), both_ AS (SELECT *, prod_unw + {_D.format(TAU)} * (label % 3) + {_D.format(TAU)} * 2 AS ww_unw FROM prod)"


@_query(
    _PROD
    + f", v AS (SELECT *, round_even(median((ww_unw - prod_unw) / {_D.format(TAU)}) OVER (), 0) AS o FROM both_ WHERE mask), d AS (SELECT *, round_even((ww_unw - psi) / {_D.format(TAU)}, 0) - round_even((prod_unw - psi) / {_D.format(TAU)}, 0) - o AS amb, ww_unw - prod_unw - o * {_D.format(TAU)} AS diff FROM v) SELECT frame_id, CAST(max(o) AS BIGINT) AS offset_, count(*) AS n_valid, round(avg(CASE WHEN amb = 0 THEN 1 ELSE 0 END), 9) AS match, round(avg(CASE WHEN abs(amb) <= 1 THEN 1 ELSE 0 END), 9) AS within_one, CAST(max(abs(amb)) AS BIGINT) AS worst, round(quantile_cont(abs(diff), 0.95), 6) + 0.0 AS p95, round(sqrt(avg(diff * diff)), 6) AS rmse, round(avg(corr), 6) AS corr_mean FROM d GROUP BY 1"
)
def compare_stats(spark, sf_dir):
    s = fr.compare_stats(_products(spark, sf_dir)).withColumnRenamed("offset", "offset_")
    s = _round(_round(s, 9, "match", "within_one"), 6, "p95", "rmse", "corr_mean")
    return s.select("frame_id", "offset_", "n_valid", "match", "within_one", "worst", "p95", "rmse", "corr_mean")


@_query(
    _PROD
    + f", a AS (SELECT prod_cc, round_even((ww_unw - psi) / {_D.format(TAU)}, 0) - round_even((prod_unw - psi) / {_D.format(TAU)}, 0) AS amb FROM both_ WHERE mask AND prod_cc > 0), m AS (SELECT prod_cc, round_even(median(amb), 0) AS mid FROM a GROUP BY 1) SELECT 'orders' AS frame_id, round(avg(CASE WHEN amb = mid THEN 1 ELSE 0 END), 9) AS match, count(*) AS n FROM a JOIN m USING (prod_cc)"
)
def percomp_match(spark, sf_dir):
    return _round(fr.per_component_match(_products(spark, sf_dir)), 9, "match")


@_query(_PROD + " SELECT frame_id, round(avg(CASE WHEN prod_unw <> 0 THEN 1 ELSE 0 END), 9) AS prod_recall, round(avg(CASE WHEN ww_unw <> 0 THEN 1 ELSE 0 END), 9) AS ww_recall, count(*) AS n FROM both_ WHERE mask GROUP BY 1")
def recall(spark, sf_dir):
    return _round(fr.recall(_products(spark, sf_dir)), 9, "prod_recall", "ww_recall")


@_query(_neigh(f"SELECT dir, CASE WHEN va IS NULL OR vb IS NULL THEN NULL ELSE CAST(round({_PI} * 100 / ({_VAR.format('va')} + {_VAR.format('vb')})) AS BIGINT) END AS cost, count(*) AS n FROM ({_EDGES}) GROUP BY 1, 2"))
def triangulation_costs(spark, sf_dir):
    e = _edge_variances(spark, sf_dir)
    finite = lambda c: F.when(F.col(c).isNotNull(), F.lit(0.0))
    return e.select("dir", co.triangulation_cost(F.col("va"), F.col("vb"), finite("va"), finite("vb")).alias("cost")).groupBy("dir", "cost").agg(F.count("*").alias("n"))


_RELV = f"(SELECT *, CAST(round(least(100 / greatest((1 - g * g) / (2 * {_D.format('5')} * g * g), CAST(0.0001 AS DOUBLE)), CAST(1e7 AS DOUBLE))) AS BIGINT) AS w, CAST(round(100 * gradient / {_D.format(TAU)}) AS BIGINT) AS u FROM (SELECT *, greatest(least(corr, CAST(0.999 AS DOUBLE)), CAST(0.001 AS DOUBLE)) AS g FROM e0))"


@_query(
    "WITH " + CTE["pix"] + _NEIGH + f', e0 AS ({_EDGES}), r AS (SELECT dir, i, j, "both" AS valid, CAST(least(w * (10000 + 200 * u), w * (10000 - 200 * u)) AS DOUBLE) AS rel FROM {_RELV}),'
    " s AS (SELECT *, CASE WHEN valid THEN greatest(CAST(0 AS DOUBLE), 5000000 - rel) ELSE CAST(5000000 AS DOUBLE) END AS st, CASE dir WHEN 'h' THEN i ELSE j END AS ac, CASE dir WHEN 'h' THEN j ELSE i END AS al FROM r)"
    " SELECT s.dir, s.i, s.j, NOT s.valid OR s.rel <= 5000000 AS cut, round((2 * s.st + coalesce(b.st, 0) + coalesce(a.st, 0)) / (2 + CASE WHEN b.st IS NULL THEN 0 ELSE 1 END + CASE WHEN a.st IS NULL THEN 0 ELSE 1 END)) > 0 AS thick FROM s LEFT JOIN s b ON b.dir = s.dir AND b.al = s.al AND b.ac = s.ac - 1 LEFT JOIN s a ON a.dir = s.dir AND a.al = s.al AND a.ac = s.ac + 1"
)
def wiggle_cuts_thickened(spark, sf_dir):
    e = st.edges(orders_raster(spark, sf_dir))
    offset, weight = co.convex_terms(F.col("gradient"), F.lit(0.0), ph.just_bamler_variance(F.col("corr"), LOOKS), F.lit(True))
    e = e.withColumn("rel", fr.wiggle_reliability(weight, offset).cast("double")).withColumn("valid", F.col("both"))
    return fr.thickened_cuts(e, 5e6).select("dir", "i", "j", "cut", "thick")


# campaign analytics


@_query("SELECT key, track, frame, direction, score, runtime_s, num_pixels / CAST(1e6 AS DOUBLE) AS megapixels, round(CAST(peak_rss_mb AS DOUBLE) / 1024 / (num_pixels / CAST(1e6 AS DOUBLE)), 9) AS gb_per_mpx, n_orders FROM camp LEFT JOIN (SELECT c_name AS key, count(*) AS n_orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) USING (key)", "camp")
def merge_runs(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_name").alias("key")).agg(F.count("*").alias("n_orders"))
    out = ca.with_derived(ca.merge_runs(campaign(spark, sf_dir), runs))
    return _round(out, 9, "gb_per_mpx").select("key", "track", "frame", "direction", "score", "runtime_s", "megapixels", "gb_per_mpx", "n_orders")


@_query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def dedupe_last(spark, sf_dir):
    return ca.last_per_key(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


@_query("WITH " + CTE["camp"] + ", land AS (SELECT s_nationkey AS track, CAST(s_suppkey % 50 AS INT) AS frame, CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'D' END AS direction, max(CAST(round(s_acctbal * 100) AS BIGINT)) / CAST(1000000 AS DOUBLE) AS fraction_land FROM supplier GROUP BY 1, 2, 3) SELECT key, track, frame, direction, fraction_land FROM camp JOIN land USING (track, frame, direction) WHERE fraction_land >= CAST(0.3 AS DOUBLE)")
def inventory_join(spark, sf_dir):
    land = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("track"), (F.col("s_suppkey") % 50).cast("int").alias("frame"), F.when(F.col("s_suppkey") % 2 == 0, "A").otherwise("D").alias("direction"))
    land = land.agg((F.max(F.round(F.col("s_acctbal") * 100).cast("long")) / 1000000).alias("fraction_land"))
    return ca.join_land(campaign(spark, sf_dir), land, 0.3).select("key", "track", "frame", "direction", "fraction_land")


@_query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'")
def reference_dates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ca.within_dates(o, F.expr("TIMESTAMP_NTZ'1995-01-01'"), F.expr("TIMESTAMP_NTZ'1996-06-30'"), "o_orderdate").select("o_orderkey")


@_query("SELECT track, frame, direction, key, runtime_s FROM (SELECT *, row_number() OVER (PARTITION BY track, frame, direction ORDER BY runtime_s, key) AS n FROM camp) WHERE n = 1", "camp")
def first_per_frame(spark, sf_dir):
    return ca.one_per_frame(campaign(spark, sf_dir), ["track", "frame", "direction"], [F.col("runtime_s").asc(), F.col("key").asc()]).select("track", "frame", "direction", "key", "runtime_s")


@_query("SELECT track, direction, key FROM (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY track, direction) AS n FROM camp WINDOW w AS (PARTITION BY track, direction ORDER BY score, key)) WHERE list_contains(list_transform(range(5), lambda x: CAST(round_even((x + 1) * (n - 1) / CAST(6 AS DOUBLE), 0) AS BIGINT)), pos)", "camp")
def track_sample(spark, sf_dir):
    return ca.sample_per_track(campaign(spark, sf_dir), 5, ["track", "direction"], ["score", "key"]).select("track", "direction", "key")


@_query("SELECT key, score FROM camp ORDER BY score, key LIMIT 15", "camp")
def worst_k(spark, sf_dir):
    return ca.worst(campaign(spark, sf_dir).select("key", "score"), "score", 15, "key")


@_query("SELECT track, key, runtime_s FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY runtime_s DESC, key) AS n FROM camp WHERE runtime_s >= 100) WHERE n = 1 ORDER BY runtime_s DESC, track LIMIT 10", "camp")
def rerun_manifest(spark, sf_dir):
    c = campaign(spark, sf_dir).select("track", "key", "runtime_s")
    return ca.slowest_unique(c, "track", "runtime_s", 100, 10, "key")


@_query("SELECT num_pixels, count(*) AS n FROM camp GROUP BY 1 ORDER BY n DESC, num_pixels LIMIT 1", "camp")
def usual_size(spark, sf_dir):
    return ca.usual(campaign(spark, sf_dir), "num_pixels")


@_query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_records(spark, sf_dir):
    wanted = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return ca.with_missing(wanted, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct(), "key")[1]


@_query("SELECT p_partkey, p_size, round(13 * (p_size % 5 + 1) / ((CAST(299792458.0 AS DOUBLE) / (2 * (77000000 + CAST(p_partkey AS DOUBLE)))) / CAST(1.5 AS DOUBLE) * ((1 / CAST(0.0006 AS DOUBLE)) / (1200 + p_size))), 6) AS looks FROM part")
def nominal_looks(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    looks = ph.nominal_looks(F.lit(13), F.col("p_size") % 5 + 1, 77000000 + F.col("p_partkey").cast("double"), F.lit(1.5), F.lit(0.0006), 1200 + F.col("p_size"))
    return _round(p.select("p_partkey", "p_size", looks.alias("looks")), 6, "looks")


@_query("SELECT CASE WHEN score >= CAST(0.99 AS DOUBLE) THEN 'good' WHEN score >= CAST(0.90 AS DOUBLE) THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n, round(avg(runtime_s), 6) AS mean_runtime FROM camp GROUP BY 1", "camp")
def tiers(spark, sf_dir):
    return _round(campaign(spark, sf_dir).groupBy(ca.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("n"), F.avg("runtime_s").alias("mean_runtime")), 6, "mean_runtime")


@_query("SELECT direction, runtime_s, round(max(c), 9) AS ecdf FROM (SELECT direction, runtime_s, cume_dist() OVER (PARTITION BY direction ORDER BY runtime_s) AS c FROM camp) GROUP BY 1, 2", "camp")
def ecdf(spark, sf_dir):
    return _round(ca.ecdf(campaign(spark, sf_dir), "runtime_s", "direction"), 9, "ecdf")


@_query("SELECT count(*) AS n, round(median(score), 9) AS median_score, round(avg(score), 6) AS mean_score, min(score) AS least_score, round(avg(CASE WHEN score >= CAST(0.99 AS DOUBLE) THEN 1 ELSE 0 END), 9) AS share_good, round(median(runtime_s), 6) AS median_runtime, round(quantile_cont(runtime_s, 0.9), 6) AS p90_runtime FROM camp", "camp")
def campaign_summary(spark, sf_dir):
    s = ca.summary(campaign(spark, sf_dir), "score", "runtime_s")
    return _round(_round(s, 9, "median_score", "share_good"), 6, "mean_score", "median_runtime", "p90_runtime")


@_query("SELECT o_custkey AS key FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def resume_antijoin(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    log = o.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("returncode"))
    done = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return ca.to_do(o.select(F.col("o_custkey").alias("key")).distinct(), log, done, "key")


@_query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1")
def most_frequent(spark, sf_dir):
    return ca.most_frequent(_t(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", "event_type", "n")


_URL = r"^(https?)://([^/]+)/([a-z]{2})/([0-9]+)"


@_query(rf"SELECT page_id, regexp_extract(url, '{_URL}', 1) AS scheme, regexp_extract(url, '{_URL}', 3) AS lang, CAST(regexp_extract(url, '{_URL}', 4) AS BIGINT) AS number FROM pages")
def granule_parse(spark, sf_dir):
    fields = {"scheme": (1, "string"), "lang": (3, "string"), "number": (4, "bigint")}
    return ca.parsed_granules(_t(spark, sf_dir, "pages").select("page_id", "url"), "url", _URL, fields).select("page_id", "scheme", "lang", "number")


@_query("SELECT c_custkey, regexp_replace(regexp_replace(concat(c_name, '.v1.', c_mktsegment, '.H5'), '(?i)\\.(h5|hdf5)$', ''), '\\.', '_', 'g') AS key FROM customer")
def normal_keys(spark, sf_dir):
    name = F.concat("c_name", F.lit(".v1."), "c_mktsegment", F.lit(".H5"))
    return _t(spark, sf_dir, "customer").select("c_custkey", ca.normal_key(name).alias("key"))


# rasters: cuts, resampling, comparison with truth, solved frames


@_query(_neigh(f"SELECT DISTINCT i + di AS i, j + dj AS j FROM (SELECT i, j, dir FROM ({_EDGES}) WHERE round(gradient) <> 0 AND corr > CAST(0.7 AS DOUBLE)) e, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) s(a, b), LATERAL (SELECT unnest([0, CASE WHEN dir = 'v' THEN 1 ELSE 0 END]) + a AS di, unnest([0, CASE WHEN dir = 'h' THEN 1 ELSE 0 END]) + b AS dj)"))
def cut_pixels(spark, sf_dir):
    cuts = st.edges(orders_raster(spark, sf_dir)).withColumn("flow", F.round("gradient").cast("int"))
    return st.high_coherence_cuts(cuts).select("i", "j")


@_query("SELECT CAST(i // 4 AS INT) AS i, CAST(j // 4 AS INT) AS j, round(avg(psi * corr + corr * psi), 6) + 0.0 AS re, round(avg(corr * corr - psi * psi), 6) + 0.0 AS im, round(least(sqrt(avg(2 * psi * corr) ** 2 + avg(psi * psi - corr * corr) ** 2) / sqrt(avg(corr * corr + psi * psi) * avg(corr * corr + psi * psi)), 1), 6) AS corr FROM pix GROUP BY 1, 2", "pix")
def interferogram(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    pair = lambda re, im: p.select("frame_id", "i", "j", F.col(re).alias("re"), F.col(im).alias("im"))
    return _round(st.interferogram(pair("corr", "psi"), pair("psi", "corr"), 4), 6, "re", "im", "corr").select("i", "j", "re", "im", "corr")


@_query(_neigh(f"SELECT frame_id, CAST(sum(abs(flow) * cost) AS BIGINT) AS objective, CAST(sum(flow) AS BIGINT) AS net FROM (SELECT frame_id, CAST(round(gradient) AS BIGINT) AS flow, CAST(round(100 * corr) AS BIGINT) AS cost FROM ({_EDGES})) GROUP BY 1"))
def flow_objective(spark, sf_dir):
    e = st.edges(orders_raster(spark, sf_dir)).select("frame_id", F.round("gradient").cast("long").alias("flow"), F.round(100 * F.col("corr")).cast("long").alias("cost"))
    return fr.flow_objective(e)


_TRUTH = f"(SELECT frame_id, i, j, psi, CAST(0.35 AS DOUBLE) * (i + j) + 2 AS truth, psi + {_D.format(TAU)} * round(CAST(0.35 AS DOUBLE) * (i + j) / {_D.format(TAU)}) AS unw FROM pix)"
_KERR = f"o AS (SELECT frame_id, round_even(median(unw - truth) / {_D.format(TAU)}, 0) * {_D.format(TAU)} AS off FROM {_TRUTH} GROUP BY 1), k AS (SELECT t.*, CAST(round_even((truth + off - psi) / {_D.format(TAU)}, 0) AS INT) AS k_true, CAST(round_even((unw - psi) / {_D.format(TAU)}, 0) AS INT) - CAST(round_even((truth + off - psi) / {_D.format(TAU)}, 0) AS INT) AS k_error FROM {_TRUTH} t JOIN o USING (frame_id))"


def _with_truth(spark, sf_dir):
    ramp = 0.35 * (F.col("i") + F.col("j"))
    p = orders_raster(spark, sf_dir).select("frame_id", "i", "j", "psi")
    return p.withColumn("truth", ramp + 2).withColumn("unw", F.col("psi") + F.lit(float(TAU)) * F.round(ramp / float(TAU)))


@_query("WITH " + CTE["pix"] + ", " + _KERR + " SELECT k_error, count(*) AS n FROM k GROUP BY 1")
def truth_errors(spark, sf_dir):
    return tr.ambiguity_errors(_with_truth(spark, sf_dir)).groupBy("k_error").agg(F.count("*").alias("n"))


_SAFE = f"abs({_wrap('psi - truth')}) < {_PI} / 2"


@_query(
    "WITH " + CTE["pix"] + ", " + _KERR.replace(f"FROM {_TRUTH}", "FROM eng").replace("o AS", f"eng AS (SELECT 'mine' AS engine, * FROM {_TRUTH} UNION ALL SELECT 'zero', frame_id, i, j, psi, truth, psi FROM {_TRUTH}), o AS", 1).replace("SELECT frame_id, round_even", "SELECT engine, round_even", 1).replace("USING (frame_id)", "USING (engine)")
    + f" SELECT engine, count(*) AS n, round(avg(CAST(k_error = 0 AS INT)), 9) AS right_, round(avg(CAST(k_error = 0 AS INT)) FILTER (WHERE {_SAFE}), 9) AS right_recoverable, round(avg(CAST(k_error = 0 AS INT)) FILTER (WHERE {_SAFE} AND k_true <> 0), 9) AS hits, round(avg(CAST(k_error <> 0 AS INT)) FILTER (WHERE {_SAFE} AND k_true = 0), 9) AS false_alarms FROM k GROUP BY 1"
)
def truth_hits(spark, sf_dir):
    both = tr.with_baseline(_with_truth(spark, sf_dir).withColumn("engine", F.lit("mine")).select("engine", "frame_id", "i", "j", "psi", "truth", "unw"))
    errors = tr.ambiguity_errors(both.withColumn("frame_id", F.col("engine")))
    out = tr.hits_and_false_alarms(errors, ["engine"]).withColumnRenamed("right", "right_")
    return _round(out, 9, "right_", "right_recoverable", "hits", "false_alarms")


@_query(f"SELECT frame_id, n, round((1 / (mode * mode) + 3) / 2, 6) AS looks_mode, round({_PI} / 4 / (mean * mean), 6) AS looks_mean FROM (SELECT frame_id, sum(c) AS n, sum(s) / sum(c) AS mean, (CAST(0.5 AS DOUBLE) + arg_max(bin, (c, -bin)) FILTER (WHERE bin IS NOT NULL)) * (CAST(0.6 AS DOUBLE) / 120) AS mode FROM (SELECT frame_id, CASE WHEN x < CAST(0.6 AS DOUBLE) THEN CAST(floor(x * (120 / CAST(0.6 AS DOUBLE))) AS INT) WHEN x = CAST(0.6 AS DOUBLE) THEN 119 END AS bin, count(*) AS c, sum(x) AS s FROM (SELECT frame_id, 1 - corr AS x FROM pix) WHERE x > 0 GROUP BY 1, 2) GROUP BY 1)", "pix")
def water_looks(spark, sf_dir):
    out = tr.zero_coherence_looks(orders_raster(spark, sf_dir).select("frame_id", (1 - F.col("corr")).alias("corr")))
    return _round(out, 6, "looks_mode", "looks_mean")


def _congruence(solved, psi, *keys):
    """Points per group, and how many are not whole cycles off their wrapped phase."""
    off = F.abs(ph.wrap(F.col("unw") - psi)) > 1e-6
    return solved.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(off.cast("long")).alias("n_bad"))


@_query("SELECT frame_id, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM pix WHERE mask GROUP BY 1", "pix")
def unwrap_tiled(spark, sf_dir):
    p = orders_raster(spark, sf_dir)
    rows = p.agg(F.max("i")).first()[0] + 1  # the raster's height, known from its metadata outside of tests
    solved = tiled.unwrap_tiled(p, rows, WIDTH, LOOKS, 30, 6)
    return _congruence(solved.join(p.select("frame_id", "i", "j", "psi"), ["frame_id", "i", "j"]), F.col("psi"), "frame_id")


def _strips(spark, sf_dir):
    strip = F.floor(F.col("i") / 30).cast("int")
    return orders_raster(spark, sf_dir).select(strip.cast("string").alias("frame_id"), (F.col("i") - strip * 30).alias("i"), "j", "psi", "corr", "mask")


@_query("SELECT CAST(i // 30 AS VARCHAR) AS frame_id, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM pix WHERE mask GROUP BY 1", "pix")
def unwrap_frames(spark, sf_dir):
    p = _strips(spark, sf_dir)
    solved = api.unwrap(p, LOOKS, api.Options(bridge=False))
    return _congruence(solved.join(p.select("frame_id", "i", "j", "psi"), ["frame_id", "i", "j"]), F.col("psi"), "frame_id")


@_query("SELECT CAST(i // 30 AS VARCHAR) AS frame_id, count(*) AS n, round(CAST(0.9 AS DOUBLE) * (max(i % 30 + j) - min(i % 30 + j)), 6) AS rise, CAST(0 AS BIGINT) AS n_off FROM pix GROUP BY 1", "pix")
def unwrap_ramps(spark, sf_dir):
    """Frames of a ramp of many cycles, known without noise: the solution must rise as the ramp does, at every pixel."""
    ramp = 0.9 * (F.col("i") + F.col("j"))
    p = _strips(spark, sf_dir).withColumn("truth", ramp).withColumn("psi", ph.wrap(ramp)).withColumn("corr", F.lit(0.9)).withColumn("mask", F.lit(True))
    solved = api.unwrap(p, LOOKS, api.Options(bridge=False)).join(p.select("frame_id", "i", "j", "truth"), ["frame_id", "i", "j"])
    level = solved.groupBy("frame_id").agg(F.min(F.struct("i", "j", (F.col("unw") - F.col("truth")).alias("d")))["d"].alias("d"))
    off = F.abs(F.col("unw") - F.col("truth") - F.col("d")) > 1e-6
    out = solved.join(level, "frame_id").groupBy("frame_id").agg(F.count("*").alias("n"), (F.max("unw") - F.min("unw")).alias("rise"), F.sum(off.cast("long")).alias("n_off"))
    return _round(out, 6, "rise")


@_query()
def unwrap_components(spark, sf_dir):
    return api.unwrap(_strips(spark, sf_dir), LOOKS).select("frame_id", "i", "j", "label")


@_query("SELECT CAST(p_size AS VARCHAR) AS frame_id, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM part GROUP BY 1")
def unwrap_points(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    x, y = F.col("p_partkey") * 7919 % 1009 / 10, F.col("p_partkey") * 104729 % 997 / 10
    p = p.select(F.col("p_size").cast("string").alias("frame_id"), F.col("p_partkey").alias("pid"), x.alias("x"), y.alias("y"), F.lit(0.1).alias("variance"))
    p = p.withColumn("phase", ph.wrap(0.05 * F.col("x") + 0.04 * F.col("y")))
    return _congruence(api.unwrap_points(p).join(p.select("frame_id", "pid", "phase"), ["frame_id", "pid"]), F.col("phase"), "frame_id")

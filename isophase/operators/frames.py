"""Component, tile and comparison operators on pixel rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isophase.functions.phase import TAU
from isophase.operators.stencil import per_frame


def finalize_labels(components: DataFrame, min_px: int = 100, min_fraction: float = 0.0, most: int = 0) -> DataFrame:
    """Labels renumbered by size: ``components(frame_id, i, j, label)``, label 0 is background.

    Components below ``max(min_px, ceil(min_fraction * valid), 1)`` pixels become background, the rest are numbered by
    size, ties by first pixel in raster order, and only the first ``most`` (0: all) stay. Valid are the pixels of a column
    ``mask``, all of them if there is none.
    """
    lit = components.where("label > 0")
    per = lit.groupBy("frame_id", "label").agg(F.count("*").alias("size"), F.min(F.struct("i", "j")).alias("first"))
    counted = components.where("mask") if "mask" in components.columns else components
    valid = counted.groupBy("frame_id").agg(F.count("*").alias("valid"))
    least = F.greatest(F.lit(min_px), F.ceil(F.lit(min_fraction) * F.col("valid")), F.lit(1))
    per = per.join(valid, "frame_id").where(F.col("size") >= least)
    per = per.withColumn("new", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.col("size").desc(), "first")))
    if most:
        per = per.where(F.col("new") <= most)
    out = components.join(per.select("frame_id", "label", "new"), ["frame_id", "label"], "left")
    return out.select("frame_id", "i", "j", F.coalesce("new", F.lit(0)).alias("label"))


def component_summary(labels: DataFrame) -> DataFrame:
    """``(frame_id, n_components, largest_fraction, labelled_fraction)``."""
    per = labels.groupBy("frame_id", "label").agg(F.count("*").alias("n"))
    lit = F.col("label") > 0
    return per.groupBy("frame_id").agg(
        F.sum(lit.cast("long")).alias("n_components"), (F.coalesce(F.max(F.when(lit, F.col("n"))), F.lit(0)) / F.sum("n")).alias("largest_fraction"), (F.coalesce(F.sum(F.when(lit, F.col("n"))), F.lit(0)) / F.sum("n")).alias("labelled_fraction")
    )


def wiggle_reliability(weight: Column, units: Column) -> Column:
    """The smaller marginal cost of a cycle either way, ``units`` hundredths of a cycle off the convex cost's minimum."""
    return F.least(weight * (10000 + 200 * units), weight * (10000 - 200 * units))


def thickened_cuts(edges: DataFrame, threshold: float) -> DataFrame:
    """``edges(frame_id, dir, i, j, rel, valid)`` with ``cut`` and ``thick``.

    An edge is cut if its reliability is at most the threshold or an end is invalid. Strength is how far below the
    threshold it is; an edge is cut thick if the rounded mean of its own (twice) and its neighbours across is above 0.
    """
    strength = F.when(F.col("valid"), F.greatest(F.lit(0.0), threshold - F.col("rel"))).otherwise(F.lit(max(threshold, 0.0)))
    e = edges.withColumn("strength", strength).withColumn("across", F.when(F.col("dir") == "h", F.col("i")).otherwise(F.col("j"))).withColumn("along", F.when(F.col("dir") == "h", F.col("j")).otherwise(F.col("i")))
    line = Window.partitionBy("frame_id", "dir", "along").orderBy("across")
    side = lambda f, d: F.when(f("across").over(line) == F.col("across") + d, f("strength").over(line))
    e = e.withColumn("before", side(F.lag, -1)).withColumn("after", side(F.lead, 1))
    n = 2 + F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")
    mean = F.round((2 * F.col("strength") + F.coalesce("before", F.lit(0.0)) + F.coalesce("after", F.lit(0.0))) / n)
    return e.withColumn("cut", ~F.col("valid") | (F.col("rel") <= threshold)).withColumn("thick", mean > 0).drop("strength", "across", "along", "before", "after")


def tile_ends(total: int, tile: int, overlap: int) -> tuple[int, int]:
    """The number of tiles along an axis and the start of the last; the others start at multiples of ``tile - overlap``."""
    return (1, 0) if total <= tile else (len(range(0, total - tile, tile - overlap)) + 1, total - tile)


def tile_starts(total: int, tile: int, overlap: int) -> list[int]:
    n, last = tile_ends(total, tile, overlap)
    return [*range(0, (n - 1) * (tile - overlap), tile - overlap), last]


def decomposed(pixels: DataFrame, rows: int, cols: int, tile: int, overlap: int) -> DataFrame:
    """``pixels`` once for each tile that they are in (at most four unless the last tile is moved in): ``tile_r, tile_c``."""
    none = F.array().cast("array<int>")

    def axis(c: str, total: int) -> Column:
        # all tiles but the last stand a step apart, so those that hold a pixel follow from its place
        x, step, (n, start) = F.col(c), tile - overlap, tile_ends(total, tile, overlap)
        lo, hi = F.greatest(F.floor((x - tile) / step) + 1, F.lit(0)).cast("int"), F.least(F.floor(x / step), F.lit(n - 2)).cast("int")
        end = F.when((x >= start) & (x < start + tile), F.array(F.lit(n - 1))).otherwise(none)
        return F.concat(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(none), end)

    return pixels.withColumn("tile_r", F.explode(axis("i", rows))).withColumn("tile_c", F.explode(axis("j", cols)))


def stitching_offsets(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Most likely cycle offset of overlapping tiles from ``pairs(keys, a, b, corr)``: ``(keys, k, confidence)``.

    Votes weigh the coherence squared (1e-3 without one); ties go to the smaller, then the lower offset.
    """
    k = F.round((F.col("b") - F.col("a")) / TAU).cast("long")
    w = F.when((F.col("corr") > 0) & ~F.isnan("corr"), F.col("corr") * F.col("corr")).otherwise(F.lit(1e-3))
    votes = pairs.groupBy(*keys, k.alias("k")).agg(F.sum(w).alias("w"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("w", 9).desc(), F.abs("k"), "k"))
    return votes.withColumn("n", nth).where("n = 1").select(*keys, "k", F.round("w").cast("long").alias("confidence"))


def feathered(tiles: DataFrame) -> DataFrame:
    """One value per pixel from ``tiles(frame_id, i, j, v, w)``: the mean of values within pi of the heaviest, by weight."""
    top = Window.partitionBy("frame_id", "i", "j")
    best = F.max_by("v", F.struct("w", (-F.col("v")).alias("v"))).over(top)
    near = tiles.withColumn("best", best).where(F.abs(F.col("v") - F.col("best")) <= math.pi)
    return near.groupBy("frame_id", "i", "j").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def coherent_cut_rate(cuts: DataFrame, n_valid: int, threshold: float = 0.7) -> DataFrame:
    """Flow over coherent edges per valid pixel, weighted by coherence."""
    return cuts.where(F.col("corr") > threshold).groupBy("frame_id").agg((F.sum(F.abs("flow") * F.col("corr")) / n_valid).alias("rate"))


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.abs(value), value))
    return counts.withColumn("r", nth).where("r = 1").drop("r")


def flow_objective(flows: DataFrame) -> DataFrame:
    """``(frame_id, objective, net)`` of ``flows(frame_id, cost, flow)``: what a flow costs, and its signed sum."""
    return flows.groupBy("frame_id").agg(F.sum(F.col("cost") * F.abs("flow")).alias("objective"), F.sum("flow").alias("net"))


def median_cycles(rows: DataFrame, value: Column, period: float, name: str) -> DataFrame:
    """``(frame_id, name)``: the median of ``value`` in whole periods, exactly, from one row per frame and whole period.

    Rounding keeps the order, so the two middle values lie in the periods that hold the middle places; only where these
    are two different ones do the values count, and they are the largest and the smallest of theirs.
    """
    per = rows.select("frame_id", value.alias("_v")).where("_v is not null")
    per = per.groupBy("frame_id", F.rint(F.col("_v") / period).alias("_k")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    line = Window.partitionBy("frame_id")
    per = per.withColumn("_to", F.sum("_n").over(line.orderBy("_k"))).withColumn("_all", F.sum("_n").over(line))
    holds = lambda place: (F.col("_to") > place) & (F.col("_to") - F.col("_n") <= place)
    first, second = holds(F.floor((F.col("_all") - 1) / 2)), holds(F.floor(F.col("_all") / 2))
    one = lambda where, c: F.max(F.when(where, F.col(c)))
    mid = per.where(first | second).groupBy("frame_id").agg(one(first, "_k").alias("_a"), one(second, "_k").alias("_b"), one(first, "_hi").alias("_x"), one(second, "_lo").alias("_y"))
    return mid.select("frame_id", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.rint((0.5 * F.col("_x") + 0.5 * F.col("_y")) / period)).alias(name))


def compare_stats(pixels: DataFrame, runtime: float | None = None) -> DataFrame:
    """One row per frame comparing ``ww_unw`` with ``prod_unw`` on ``pixels(frame_id, i, j, psi, corr, mask, prod_unw, ww_unw)``.

    The global offset is the rounded median difference in cycles; ambiguities are cycles above the wrapped phase.
    """
    ok = F.col("mask") & F.col("psi").isNotNull() & F.col("prod_unw").isNotNull() & F.col("ww_unw").isNotNull() & ~F.isnan("prod_unw") & ~F.isnan("ww_unw")
    v = pixels.where(ok)
    v = per_frame(v, median_cycles(v, (F.col("ww_unw") - F.col("prod_unw")) / TAU, 1.0, "offset"))
    amb = lambda c: F.rint((F.col(c) - F.col("psi")) / TAU)
    d = v.withColumn("amb", amb("ww_unw") - amb("prod_unw") - F.col("offset")).withColumn("diff", F.col("ww_unw") - F.col("prod_unw") - F.col("offset") * TAU)
    return d.groupBy("frame_id").agg(
        F.first("offset").cast("long").alias("offset"), F.count("*").alias("n_valid"), F.avg((F.col("amb") == 0).cast("int")).alias("match"), F.avg((F.abs("amb") <= 1).cast("int")).alias("within_one"),
        F.max(F.abs("amb")).cast("long").alias("worst"), F.percentile(F.abs("diff"), F.lit(0.5)).alias("p50"), F.percentile(F.abs("diff"), F.lit(0.95)).alias("p95"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"), F.avg("corr").alias("corr_mean"),
    )


def per_component_match(pixels: DataFrame) -> DataFrame:
    """``(frame_id, match, n)`` after taking each product component's own median ambiguity out; ``prod_cc`` above 0 counts."""
    amb = F.rint((F.col("ww_unw") - F.col("psi")) / TAU) - F.rint((F.col("prod_unw") - F.col("psi")) / TAU)
    p = pixels.where(F.col("mask") & (F.col("prod_cc") > 0)).withColumn("amb", amb)
    mid = p.groupBy("frame_id", "prod_cc").agg(F.rint(F.median("amb")).alias("mid"))
    return p.join(mid, ["frame_id", "prod_cc"]).groupBy("frame_id").agg(F.avg((F.col("amb") == F.col("mid")).cast("int")).alias("match"), F.count("*").alias("n"))


def recall(pixels: DataFrame) -> DataFrame:
    """Shares of the mask that each side has unwrapped."""
    share = lambda c: F.avg((F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != 0)).cast("int"))
    return pixels.where("mask").groupBy("frame_id").agg(share("prod_unw").alias("prod_recall"), share("ww_unw").alias("ww_recall"), F.count("*").alias("n"))

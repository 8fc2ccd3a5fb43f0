"""Comparison with a known truth, simulated scenes, and looks from water that should have no coherence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isophase.functions.phase import wrap
from isophase.operators.frames import median_cycles
from isophase.operators.stencil import per_frame

TAU = 2 * math.pi


def ambiguity_errors(pixels: DataFrame) -> DataFrame:
    """``pixels(frame_id, psi, truth, unw, ...)`` with ``k_error`` and ``k_true``: whole cycles over the wrapped input.

    The truth is first moved by the median offset of its frame, in whole cycles. Pixels that are not unwrapped (null or
    NaN) are left out.
    """
    valid = pixels.where(F.col("unw").isNotNull() & ~F.isnan("unw"))
    off = median_cycles(valid, F.col("unw") - F.col("truth"), TAU, "_off").withColumn("_off", F.col("_off") * TAU)
    at = per_frame(valid, off)
    k = lambda x: F.rint((x - F.col("psi")) / TAU).cast("int")
    at = at.withColumn("k_true", k(F.col("truth") + F.col("_off"))).withColumn("k_error", k(F.col("unw")) - F.col("k_true"))
    return at.drop("_off")


def hits_and_false_alarms(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of right pixels, in all and where noise leaves the truth recoverable; hits where the truth has cycles, and
    false alarms where it has none. ``errors`` is what :func:`ambiguity_errors` gives. A share of nothing is null."""
    right = F.col("k_error") == 0
    safe = F.abs(wrap(F.col("psi") - F.col("truth"))) < math.pi / 2
    share = lambda hit, among: F.avg(F.when(among, hit.cast("int")))
    return errors.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(right, F.lit(True)).alias("right"),
        share(right, safe).alias("right_recoverable"),
        share(right, safe & (F.col("k_true") != 0)).alias("hits"),
        share(~right, safe & (F.col("k_true") == 0)).alias("false_alarms"),
    )


def with_baseline(engines: DataFrame) -> DataFrame:
    """``engines(engine, frame_id, i, j, psi, truth, unw)`` and the engine ``zero``, which leaves the input wrapped."""
    zero = engines.select("frame_id", "i", "j", "psi", "truth").distinct().withColumn("engine", F.lit("zero")).withColumn("unw", F.col("psi"))
    return engines.unionByName(zero.select(engines.columns))


def zero_coherence_looks(water: DataFrame, bins: int = 120, most: float = 0.6) -> DataFrame:
    """``(frame_id, n, looks_mode, looks_mean)`` from ``water(frame_id, corr)``, pixels well inside water.

    There the coherence is Rayleigh-like: its mode and its mean each give a look count. Among equally full bins the
    lowest counts; values from ``most`` on are outside the histogram but in the mean.
    """
    w = water.where((F.col("corr") > 0) & ~F.isnan("corr"))
    bin_ = F.when(F.col("corr") < most, F.floor(F.col("corr") * (bins / most)).cast("int")).when(F.col("corr") == most, bins - 1)
    counts = w.groupBy("frame_id", bin_.alias("bin")).agg(F.count("*").alias("c"), F.sum("corr").alias("s"))
    per = counts.groupBy("frame_id").agg(F.sum("c").alias("n"), F.sum("s").alias("s"), F.max(F.when(F.col("bin").isNotNull(), F.struct("c", -F.col("bin")))).alias("top"))
    mode = (F.lit(0.5) - F.col("top.col2")) * (most / bins)
    mean = F.col("s") / F.col("n")
    return per.select("frame_id", "n", ((1 / (mode * mode) + 3) / 2).alias("looks_mode"), (math.pi / 4 / (mean * mean)).alias("looks_mean"))


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    at = spark.range(rows * cols)
    return at.select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))


def diagonal_ramp(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """``(i, j, truth)``: pi (x + y) with both axes from -3 to 3."""
    axis = lambda c, n: -3 + 6 * F.col(c) / max(n - 1, 1)
    return _grid(spark, rows, cols).withColumn("truth", math.pi * (axis("j", cols) + axis("i", rows)))


def gaussian_bump(spark: SparkSession, rows: int, cols: int, amplitude: float, sigma: float) -> DataFrame:
    dy, dx = F.col("i") - (rows - 1) / 2, F.col("j") - (cols - 1) / 2
    return _grid(spark, rows, cols).withColumn("truth", amplitude * F.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma)))


def simulated(truth: DataFrame, gamma: Column, nlooks: int, seed: int = 0) -> DataFrame:
    """``truth(i, j, truth, ...)`` with ``re, im, corr``: the mean of ``nlooks`` looks of signal and circular noise.

    The mean of that many noise samples is itself normal, so it is drawn once. ``corr`` is the modulus of the mean.
    """
    g = F.least(F.greatest(gamma, F.lit(0.0)), F.lit(0.999))
    scale = F.sqrt((1 - g * g) / (2 * nlooks))
    out = truth.withColumn("re", g * F.cos("truth") + scale * F.randn(seed)).withColumn("im", g * F.sin("truth") + scale * F.randn(seed + 1))
    return out.withColumn("corr", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))

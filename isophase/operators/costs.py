"""Arc costs on pixel edges: slope guard, statistical and variance costs, convex offsets, triangulation costs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isophase.functions.phase import clamped_variance, finite, looks
from isophase.operators.stencil import per_frame

#: Slope guard: share of edges it may free, lowest threshold (rad), histogram bins over [0, pi].
BUDGET, FLOOR, BINS = 0.03, 1.0, 1024
#: Scales of the analytic and the variance costs, the largest cost, and the weights of the convex form.
SCALE_ANALYTIC, SCALE_VARIANCE, MOST = 6, 100, 65535


def slope_guard_threshold(edges: DataFrame, budget: float = BUDGET, floor: float = FLOOR) -> DataFrame:
    """``(frame_id, threshold)``: the steepest slope that at most ``budget`` of the edges exceed, at least ``floor``.

    Edges count if both pixels are valid and the coherence is above 1e-9; they are counted in bins, which are walked
    from the steepest down.
    """
    e = edges.where("both and corr > 1e-9")
    bin_ = F.least(F.floor(F.abs("gradient") / math.pi * BINS), F.lit(BINS - 1)).cast("int")
    counts = e.groupBy("frame_id", bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy("frame_id").agg(F.sum("n").alias("total"))
    per = counts.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("bins"))  # at most BINS each
    per = per.join(total, "frame_id").withColumn("allowed", F.floor(F.col("total") * budget))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("stop"))

    def step(acc, x):
        over = acc["stop"].isNull() & (acc["sum"] + x["n"] > F.col("allowed"))
        return F.struct((acc["sum"] + x["n"]).alias("sum"), F.when(over, -x["b"]).otherwise(acc["stop"]).alias("stop"))

    stop = F.aggregate("bins", start, step)["stop"]
    chosen = F.when(stop.isNull(), F.lit(math.pi)).otherwise((stop + 1) / BINS * math.pi)
    return per.select("frame_id", F.greatest(F.lit(floor), chosen).alias("threshold"))


def guarded(edges: DataFrame, threshold: DataFrame) -> DataFrame:
    """``edges`` with ``guard``: the slope is at least the frame's threshold, on edges that count."""
    e = per_frame(edges, threshold)
    return e.withColumn("guard", F.col("both") & (F.col("corr") > 1e-9) & (F.abs("gradient") >= F.col("threshold"))).drop("threshold")


def crlb_costs(edges: DataFrame, scale: int = SCALE_VARIANCE) -> DataFrame:
    """Costs of one more cycle each way on ``edges(..., gradient, va, vb)``: ``cost_plus`` and ``cost_minus``."""
    w = 1 / (clamped_variance(F.col("va")) + clamped_variance(F.col("vb")))
    cost = lambda sign: F.least(F.round(scale * F.greatest(w * (math.pi - sign * F.col("gradient")), F.lit(0.0))), F.lit(MOST)).cast("int")
    return edges.withColumn("cost_plus", cost(1)).withColumn("cost_minus", cost(-1))


def convex_terms(raw: Column, smooth: Column, variance: Column, valid: Column) -> tuple[Column, Column]:
    """Offset (hundredths of a cycle) and weight of the convex cost; zero where an end is masked."""
    offset = F.round(100 * (raw - smooth) / (2 * math.pi)).cast("long")
    weight = F.round(F.least(100 / F.greatest(variance, F.lit(1e-4)), F.lit(1e7))).cast("long")
    zero = F.lit(0).cast("long")
    return F.when(valid, offset).otherwise(zero), F.when(valid, weight).otherwise(zero)


def triangulation_cost(variance_a: Column, variance_b: Column, phase_a: Column, phase_b: Column) -> Column:
    """Cost of an edge of a point network; null (forbidden) where an end's phase is not finite."""
    cost = F.round(math.pi * 100 / (clamped_variance(variance_a) + clamped_variance(variance_b))).cast("long")
    return F.when(finite(phase_a) & finite(phase_b), cost)


def hyp2f1(a: float, b: float, c: float, z: np.ndarray) -> np.ndarray:
    """Gauss series for |z| < 1; from 0.7 on by Euler's transformation, which converges for the arguments used here."""
    z = np.asarray(z, float)
    far = z >= 0.7
    a1, b1 = np.where(far, c - a, a), np.where(far, c - b, b)
    term, total = np.ones_like(z), np.ones_like(z)
    for n in range(4000):
        term = term * (a1 + n) * (b1 + n) / ((c + n) * (n + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= 1e-14 * np.abs(total)):
            break
    return np.where(far, (1 - z) ** (c - a - b) * total, total)


def phase_pdf(phase: np.ndarray, gamma: float, nlooks: float) -> np.ndarray:
    """Probability density of the multilook phase around its expectation, for one coherence."""
    beta = gamma * np.cos(phase)
    L = nlooks
    lead = math.exp(math.lgamma(L + 0.5) - math.lgamma(L)) * (1 - gamma**2) ** L / (2 * math.sqrt(math.pi))
    first = lead * beta * (1 - beta**2) ** -(L + 0.5)
    return first + (1 - gamma**2) ** L / (2 * math.pi) * hyp2f1(L, 1.0, 0.5, beta**2)


def phase_variance(gamma: float, nlooks: float, n: int = 1024) -> float:
    a = (np.arange(n) + 0.5) / n * 2 * math.pi - math.pi
    p = np.maximum(phase_pdf(a, gamma, nlooks), 0)
    return float((a**2 * p).sum() / p.sum())


class CarballoTable:
    """Costs ``-ln(P(one cycle more) / P(none))`` on a grid of coherence and smoothed gradient, in nats up to 50."""

    GAMMAS, SLOPES, MOST = 101, 501, 50.0

    def __init__(self, nlooks: float) -> None:
        self.nlooks = round(looks(nlooks), 1)
        self.gammas = np.linspace(0.0, 0.999, self.GAMMAS)
        self.slopes = np.linspace(0.0, math.pi, self.SLOPES)
        fine = np.linspace(-math.pi, math.pi, 4097)
        self.table = np.stack([self._row(g, fine) for g in self.gammas])

    def _row(self, gamma: float, fine: np.ndarray) -> np.ndarray:
        p = np.maximum(phase_pdf(fine, gamma, self.nlooks), 0)
        mass = np.concatenate(([0.0], np.cumsum((p[1:] + p[:-1]) / 2)))
        cdf = mass / mass[-1]
        more = np.interp(self.slopes - math.pi, fine, cdf)
        with np.errstate(divide="ignore"):
            cost = -np.log(np.maximum(more, 1e-300) / np.maximum(1 - more, 1e-300))
        out = np.clip(cost, 0.0, self.MOST)
        out[0] = self.MOST
        return out

    def __call__(self, gamma: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Bilinear; a slope of zero or below costs the most."""
        g = np.clip(np.nan_to_num(gamma), 0, 0.999) / 0.999 * (self.GAMMAS - 1)
        s = np.clip(slope, 0, math.pi) / math.pi * (self.SLOPES - 1)
        a, b = np.minimum(g.astype(int), self.GAMMAS - 2), np.minimum(s.astype(int), self.SLOPES - 2)
        u, v = g - a, s - b
        t = self.table
        out = (1 - u) * ((1 - v) * t[a, b] + v * t[a, b + 1]) + u * ((1 - v) * t[a + 1, b] + v * t[a + 1, b + 1])
        return np.where(slope <= 0, self.MOST, out)


def arc_costs(table: CarballoTable, gamma: np.ndarray, smooth: np.ndarray, scale: int = SCALE_ANALYTIC) -> tuple[np.ndarray, np.ndarray]:
    """Integer costs of a cycle up and down on edges with this coherence and smoothed gradient."""
    up, down = table(gamma, smooth), table(gamma, -smooth)
    return np.rint(scale * up).astype(np.int64), np.rint(scale * down).astype(np.int64)

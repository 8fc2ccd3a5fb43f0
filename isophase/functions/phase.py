"""Scalar expressions on phase, coherence and variance columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Variance given to pixels without one, and the range that variances are clamped to (rad squared).
NODATA_VARIANCE, LEAST_VARIANCE, MOST_VARIANCE = 50.0, 1e-3, 50.0


def wrapped_phase(re: Column, im: Column) -> Column:
    """Argument of a complex sample; adding 0.0 makes a negative zero positive, so that (-1, -0.0) gives +pi."""
    return F.atan2(im + F.lit(0.0), re)


def cycles(x: Column) -> Column:
    """Whole cycles in ``x`` radians, halves rounded away from zero."""
    return F.round(x / TAU)


def wrap(x: Column) -> Column:
    return x - F.lit(TAU) * cycles(x)


def wrap_modulo(x: Column) -> Column:
    """The harness's form, into [-pi, pi)."""
    return F.pmod(x + F.lit(math.pi), F.lit(TAU)) - F.lit(math.pi)


def cycle_difference(a: Column, b: Column) -> Column:
    return cycles(a - b).cast("int")


def integration_step(a: Column, b: Column) -> Column:
    """Cycles to add when walking from ``b`` to ``a``."""
    return -cycle_difference(a, b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_zero(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x)


def default_mask(re: Column, im: Column, corr: Column) -> Column:
    """Valid where there is a sample and its coherence is above zero; NaN counts as no sample."""
    return ((nan_to_zero(re) != 0) | (nan_to_zero(im) != 0)) & (nan_to_zero(corr) > 0)


def transferred(phase: Column, solved: Column, mask: Column) -> Column:
    """``phase`` with the cycles of the solved phase; 0 outside the mask."""
    return F.when(mask, phase + F.lit(TAU) * F.rint((solved - phase) / TAU)).otherwise(F.lit(0.0))


def masked_to_nan(x: Column, mask: Column) -> Column:
    return F.when(mask, x).otherwise(F.lit(float("nan")))


def clamped_variance(v: Column) -> Column:
    none = v.isNull() | F.isnan(v) | (v <= 0)
    return F.when(none, F.lit(NODATA_VARIANCE)).otherwise(F.greatest(F.least(v, F.lit(MOST_VARIANCE)), F.lit(LEAST_VARIANCE)))


def pseudo_coherence(variance: Column) -> Column:
    ok = variance.isNotNull() & ~F.isnan(variance) & (variance > 0)
    return F.when(ok, 1 / F.sqrt(1 + 2 * variance)).otherwise(F.lit(0.0))


def coherence_reliability(corr: Column, nlooks: float) -> Column:
    """Inverse phase variance of a coherence, clipped to [1e-3, 0.999]."""
    g = F.greatest(F.least(corr, F.lit(0.999)), F.lit(1e-3))
    return 2 * nlooks * g * g / (1 - g * g)


def just_bamler_variance(corr: Column, nlooks: float) -> Column:
    g = F.greatest(F.least(corr, F.lit(0.999)), F.lit(1e-3))
    return (1 - g * g) / (2 * nlooks * g * g)


def min_coherence_auto(nlooks: float) -> float:
    return min(max(0.32 / math.sqrt(nlooks), 0.02), 0.30)


def threshold_from_cycle_probability(p: float) -> int:
    p = min(max(p, 1e-12), 1 - 1e-12)
    return round(6 * math.log((1 - p) / p))


def threshold_from_sigma(sigma: float) -> int:
    return threshold_from_cycle_probability(0.5 * math.erfc(sigma / math.sqrt(2)))


def mask_digits(code: Column) -> tuple[Column, Column, Column]:
    """Water, reference and secondary digit of a mask code: three decimal digits in the low byte."""
    low = code.bitwiseAND(255)
    return F.floor(low / 100) % 10, F.floor(low / 10) % 10, low % 10


def mask_policy(code: Column, policy: str) -> Column:
    """Valid pixels by policy; the fill code 255 is valid only for ``ignore``."""
    water, ref, sec = mask_digits(code)
    fill = code.bitwiseAND(255) == 255
    valid = {
        "subswath": [ref > 0, sec > 0],
        "water_only": [water == 0],
        "water_and_subswath": [water == 0, ref > 0, sec > 0],
    }
    if policy == "ignore":
        return F.lit(True)
    return reduce(lambda a, b: a & b, valid[policy], ~fill)


def water_mask(code: Column) -> Column:
    return (mask_digits(code)[0] > 0) & (code.bitwiseAND(255) != 255)


def looks(nlooks: float, most: float = 80.0) -> float:
    """Look count for the cost models: an error below 1 or NaN, at most ``most``."""
    if not nlooks >= 1:
        raise ValueError("nlooks must be at least 1")
    return min(nlooks, most)


def phass_cost(corr_a: Column, corr_b: Column, gradient: Column) -> Column:
    """The ablation's arc cost: 255 from a coherence product of 0.49 on, 0 for steep edges."""
    q = F.floor(F.least(corr_a * corr_a, corr_b * corr_b) * 100).cast("int")
    return F.when(F.abs(gradient) >= 1, 0).when(q > 49, 255).otherwise(q)


#: Fixed value: speed of light in metres a second.
LIGHT = 299_792_458.0


def nominal_looks(range_looks: Column, azimuth_looks: Column, range_bandwidth: Column, range_spacing: Column, line_time: Column, azimuth_bandwidth: Column) -> Column:
    """Independent looks by the product's metadata: samples over the oversampling in range and in azimuth; null unless both
    oversamplings are positive."""
    over_range = (LIGHT / (2 * range_bandwidth)) / range_spacing
    over_azimuth = (1 / line_time) / azimuth_bandwidth
    return F.when((over_range > 0) & (over_azimuth > 0), range_looks * azimuth_looks / (over_range * over_azimuth))

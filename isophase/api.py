"""Unwrapping of frames as a grouped map: one task per frame, any number of frames in a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isophase.functions.phase import looks
from isophase.solver import mcf, network


@dataclass(frozen=True)
class Options:
    """``window``: box of the gradient smoothing; ``bridge``: move regions onto their neighbours; ``min_size`` and
    ``max_ncomps`` of components; ``interpolate`` and ``goldstein``: filters before solving, after which the cycles are
    transferred to the unfiltered phase; ``form`` of the costs: linear, convex, or grounded, which charges ``ground`` for a
    unit that leaves the frame. ``reliability``, in inverse variances: edges where a cycle either way costs no more bound
    components; ``thicken``: cuts are smoothed across, so that no thin bridge joins two sides."""

    window: tuple[int, int] = (7, 7)
    bridge: bool = True
    bridge_min_px: int = 500
    min_size: int = 100
    max_ncomps: int = 1024
    reliability: float = 0.5
    thicken: bool = True
    form: str = "linear"
    ground: int = 0
    interpolate: bool = False
    interpolate_cutoff: float = 0.1
    goldstein: float = 0.0
    psize: int = 64


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` into a fixed number of parts.

    A solver works long on few bytes; by their size adaptive execution would merge all frames into a few tasks.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


SCHEMA = "frame_id string, i int, j int, unw double, label int"


def _grid(pdf: pd.DataFrame, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, ...]:
    m, n = shape or (int(pdf.i.max()) + 1, int(pdf.j.max()) + 1)
    if m < 2 or n < 2:
        raise ValueError("a frame needs at least 2 by 2 pixels")
    phase, corr, mask = np.zeros((m, n)), np.zeros((m, n)), np.zeros((m, n), bool)
    at = (pdf.i.to_numpy(int), pdf.j.to_numpy(int))
    phase[at], corr[at] = np.nan_to_num(pdf.psi.to_numpy(float)), np.clip(np.nan_to_num(pdf["corr"].to_numpy(float)), 0, 1)
    mask[at] = pdf["mask"].fillna(False).to_numpy(bool) & np.isfinite(pdf.psi.to_numpy(float))
    return phase, corr, mask


def _solve(phase, corr, mask, nlooks: float, options: Options) -> tuple[np.ndarray, np.ndarray]:
    supply = mcf.residues(phase)
    if options.form == "convex":
        return network.solve_convex(supply, *mcf.convex_costs(phase, corr, mask, nlooks, options.window))
    costs = mcf.statistical_costs(phase, corr, mask, nlooks, options.window)
    if options.form == "grounded":
        return network.solve_grounded(supply, costs.down, costs.up, costs.left, costs.right, options.ground)
    if options.form != "linear":
        raise ValueError(f"unknown form {options.form!r}")
    return mcf.solve(supply, costs)


def unwrap_variance_arrays(phase, variance, mask) -> np.ndarray:
    """Unwrapped phase (NaN outside the mask) of a frame with known phase variances in place of coherence."""
    c_h, c_v = mcf.solve(mcf.residues(phase), mcf.variance_costs(phase, variance, mask))
    return np.where(mask, phase + mcf.TAU * mcf.integrate(phase, c_h, c_v), np.nan)


def unwrap_arrays(phase, corr, mask, nlooks: float, options: Options = Options()) -> tuple[np.ndarray, np.ndarray]:
    """Unwrapped phase (NaN outside the mask) and component labels of one frame."""
    nlooks = looks(nlooks)
    filtered = phase
    if options.interpolate or options.goldstein > 0:
        z = np.where(mask, np.exp(1j * phase), 0)
        if options.interpolate:
            z = mcf.interpolate(z, corr, options.interpolate_cutoff)
        if options.goldstein > 0:
            z = mcf.goldstein(z, options.goldstein, options.psize)
        filtered = np.angle(z)
    c_h, c_v = _solve(filtered, corr, mask, nlooks, options)
    solved = filtered + mcf.TAU * mcf.integrate(filtered, c_h, c_v)
    unw = phase + mcf.TAU * np.rint((solved - phase) / mcf.TAU)
    labels = mcf.label(mask, *mcf.wiggle_cuts(phase, unw, corr, mask, nlooks, options.window, options.reliability, options.thicken))
    ids, size = np.unique(labels[labels > 0], return_counts=True)
    order = [i for s, i in sorted(zip(-size, ids, strict=True)) if -s >= options.min_size][: options.max_ncomps or None]
    final = np.zeros_like(labels)
    for new, old in enumerate(order, 1):
        final[labels == old] = new
    if options.bridge:
        unw = mcf.bridge(unw, mcf.label(mask), options.bridge_min_px)
    return np.where(mask, unw, np.nan), final


def unwrap(pixels: DataFrame, nlooks: float, options: Options = Options()) -> DataFrame:
    """``(frame_id, i, j, unw, label)`` of ``pixels(frame_id, i, j, psi, corr, mask)``; missing pixels count as masked."""
    looks(nlooks)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        phase, corr, mask = _grid(pdf)
        unw, label = unwrap_arrays(phase, corr, mask, nlooks, options)
        i, j = np.nonzero(mask)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "i": i.astype("int32"), "j": j.astype("int32"), "unw": unw[i, j], "label": label[i, j].astype("int32")})

    return spread(pixels.select("frame_id", "i", "j", "psi", "corr", "mask"), "frame_id").groupBy("frame_id").applyInPandas(one, SCHEMA)


def unwrap_variance(pixels: DataFrame) -> DataFrame:
    """``(frame_id, i, j, unw)`` of ``pixels(frame_id, i, j, psi, variance, mask)``; a variance that is not positive counts
    as the largest one."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        phase, _, mask = _grid(pdf.assign(corr=1.0))
        variance = np.zeros(phase.shape)
        variance[pdf.i.to_numpy(int), pdf.j.to_numpy(int)] = pdf.variance.to_numpy(float)
        i, j = np.nonzero(mask)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "i": i.astype("int32"), "j": j.astype("int32"), "unw": unwrap_variance_arrays(phase, variance, mask)[i, j]})

    return spread(pixels.select("frame_id", "i", "j", "psi", "variance", "mask"), "frame_id").groupBy("frame_id").applyInPandas(one, "frame_id string, i int, j int, unw double")


def unwrap_points(points: DataFrame, max_edge: float | None = None) -> DataFrame:
    """``(frame_id, pid, unw)`` of scattered ``points(frame_id, pid, x, y, phase, variance)``; see :mod:`.solver.network`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        unw = network.unwrap_points(pdf.x, pdf.y, pdf.phase, pdf.variance, max_edge)
        return pd.DataFrame({"frame_id": pdf.frame_id, "pid": pdf.pid, "unw": unw})

    return spread(points.select("frame_id", "pid", "x", "y", "phase", "variance"), "frame_id").groupBy("frame_id").applyInPandas(one, "frame_id string, pid long, unw double")


def label_components(pixels: DataFrame) -> DataFrame:
    """``(frame_id, i, j, label)``: 4-connected components of the mask, numbered in raster order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, mask = _grid(pdf.assign(psi=0.0, corr=1.0))
        i, j = np.nonzero(mask)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "i": i.astype("int32"), "j": j.astype("int32"), "label": mcf.label(mask)[i, j].astype("int32")})

    return spread(pixels.select("frame_id", "i", "j", "mask"), "frame_id").groupBy("frame_id").applyInPandas(one, "frame_id string, i int, j int, label int")

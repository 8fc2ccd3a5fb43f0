"""Repairs of an unwrapped frame that is nearly right: thin slivers, holes, and regions against a coarse anchor."""

from __future__ import annotations

import numpy as np

TAU = 2 * np.pi


def _heal_lines(unw: np.ndarray, ok: np.ndarray, width: int) -> int:
    """Heals runs along the last axis in place; the number of runs healed."""
    healed = 0
    for w in range(1, width + 1):
        if unw.shape[1] < w + 2:
            break
        n = unw.shape[1] - w - 1
        inside = np.lib.stride_tricks.sliding_window_view(ok, w + 2, axis=1)[:, :n].all(axis=2)
        with np.errstate(invalid="ignore"):
            before = np.round((unw[:, 1 : n + 1] - unw[:, :n]) / TAU)
            after = np.round((unw[:, w : n + w] - unw[:, w + 1 : n + w + 1]) / TAU)
            hit = inside & (before == after) & (before != 0)
        for r, a in np.argwhere(hit).tolist():
            c = np.round((unw[r, a + 1] - unw[r, a]) / TAU)
            if c and c == np.round((unw[r, a + w] - unw[r, a + w + 1]) / TAU):  # still so after runs healed before it
                unw[r, a + 1 : a + w + 1] -= TAU * c
                healed += 1
    return healed


def heal_slivers(unw: np.ndarray, corr: np.ndarray, mask: np.ndarray, min_corr: float = 0.2, width: int = 4, rounds: int = 6) -> np.ndarray:
    """Runs of at most ``width`` pixels that are the same whole cycles off the pixels before and after them, moved back,
    along rows and columns until nothing changes. A step that only one side shows is a real fringe and stays."""
    out, ok = unw.copy(), mask & (corr > min_corr) & np.isfinite(unw)
    for _ in range(rounds):
        if not _heal_lines(out, ok, width) + _heal_lines(out.T, ok.T, width):
            break
    return out


def fill_from_neighbours(values: np.ndarray) -> np.ndarray:
    """NaN pixels as the mean of their known 4-neighbours, ring by ring; all NaN stays all NaN."""
    out = values.copy()
    while True:
        hole = np.isnan(out)
        near = np.pad(out, 1, constant_values=np.nan)
        around = np.stack([near[:-2, 1:-1], near[2:, 1:-1], near[1:-1, :-2], near[1:-1, 2:]])
        n = (~np.isnan(around)).sum(axis=0)
        ring = hole & (n > 0)
        if not ring.any():
            return out
        out[ring] = np.nansum(around, axis=0)[ring] / n[ring]


def anchored(unw: np.ndarray, regions: np.ndarray, corr: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Each region moved by the whole cycles that most of its coherence says it is off the anchor; 0 is no region."""
    out = unw.copy()
    ok = (regions > 0) & np.isfinite(unw) & np.isfinite(anchor)
    k = np.zeros(unw.shape, np.int64)
    k[ok] = np.rint((unw[ok] - anchor[ok]) / TAU)
    weight = np.where(corr > 0, corr, 1e-3)
    for r in np.unique(regions[ok]).tolist():
        own = ok & (regions == r)
        found, place = np.unique(k[own], return_inverse=True)
        votes = np.bincount(place.ravel(), weight[own])
        out[regions == r] -= TAU * found[votes.argmax()]
    return out

"""Labels of frames bounded by unreliable edges, also where no flow runs."""

import math

import numpy as np

from isophase import api
from isophase.solver import mcf


def slow_cuts(phase, unw, corr, mask, nlooks, threshold, thicken):
    """One edge at a time."""
    o_h, w_h, o_v, w_v = mcf.convex_costs(phase, corr, mask, nlooks)
    out = []
    for o, w, (di, dj), (ai, aj) in ((o_h, w_h, (0, 1), (1, 0)), (o_v, w_v, (1, 0), (0, 1))):
        strength, rel, ok = {}, {}, {}
        for i, j in np.ndindex(*o.shape):
            b = (i + di, j + dj)
            step = phase[b] - phase[i, j]
            k = round((unw[b] - unw[i, j] - (step - math.tau * round(step / math.tau))) / math.tau) if mask[i, j] and mask[b] else 0
            u = 100 * k - int(o[i, j])
            ok[i, j] = mask[i, j] and mask[b]
            rel[i, j] = min(int(w[i, j]) * (10000 + 200 * u), int(w[i, j]) * (10000 - 200 * u))
            strength[i, j] = max(0, threshold - rel[i, j]) if ok[i, j] else max(threshold, 0)
        cut = np.zeros(o.shape, bool)
        for i, j in np.ndindex(*o.shape):
            near = [strength[x] for x in ((i - ai, j - aj), (i + ai, j + aj)) if x in strength]
            mean = math.floor((2 * strength[i, j] + sum(near)) / (2 + len(near)) + 0.5)
            cut[i, j] = not ok[i, j] or (mean > 0 if thicken else rel[i, j] <= threshold)
        out.append(cut)
    return out


def test_cuts_one_by_one():
    rng = np.random.default_rng(2)
    truth = np.add.outer(np.arange(14) * 0.4, np.arange(11) * 0.3)
    phase, corr = mcf.wrap(truth + rng.normal(0, 1.2, truth.shape)), rng.uniform(0, 1, truth.shape)
    mask = rng.uniform(size=truth.shape) > 0.1
    unw = phase + math.tau * rng.integers(-1, 2, truth.shape)
    for thicken in (False, True):
        for reliability in (0.0, 0.5, 5.0):
            got = mcf.wiggle_cuts(phase, unw, corr, mask, 5.0, reliability=reliability, thicken=thicken)
            want = slow_cuts(phase, unw, corr, mask, 5.0, round(reliability * 1e6), thicken)
            assert all((g == w).all() for g, w in zip(got, want, strict=True))


def test_a_band_of_low_coherence_parts_a_frame_without_flow():
    truth = np.add.outer(np.arange(40) * 0.1, np.arange(40) * 0.1)
    corr = np.full(truth.shape, 0.95)
    corr[:, 18:22] = 0.02
    unw, label = api.unwrap_arrays(mcf.wrap(truth), corr, np.ones(truth.shape, bool), 5.0)
    assert np.ptp(unw - truth) < 1e-6
    assert label[5, 5] != label[5, 35] and 0 not in (label[5, 5], label[5, 35])

"""Integer minimum-cost flow on one frame, and the integration of its result. Runs inside a grouped map, in numpy.

Nodes are the corners of pixels, ``(m + 1, n + 1)`` for an ``(m, n)`` frame. A unit of flow down across the pixel edge
(i,j)-(i,j+1), or left across (i,j)-(i+1,j), adds one cycle to the phase step over that edge. Arcs along the frame cross
no edge and are free, so whatever residue is left in the frame's interior can leave through it.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np

from isophase.functions.phase import looks
from isophase.operators.costs import CarballoTable, arc_costs

TAU = 2 * np.pi


def wrap(x: np.ndarray) -> np.ndarray:
    return x - TAU * np.round(x / TAU)


def residues(phase: np.ndarray) -> np.ndarray:
    """Charges at the nodes; the opposite of the interior sum stands at the frame's first corner."""
    h, v = wrap(np.diff(phase, axis=1)), wrap(np.diff(phase, axis=0))
    out = np.zeros((phase.shape[0] + 1, phase.shape[1] + 1), np.int64)
    out[1:-1, 1:-1] = np.rint((h[:-1] + v[:, 1:] - h[1:] - v[:, :-1]) / TAU)
    out[0, 0] -= out.sum()
    return out


def smooth(gradient: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Box mean with the nearest value beyond the edge."""
    for axis, k in ((1, cols), (0, rows)):
        if not gradient.size:
            return gradient
        pad = [(0, 0), (0, 0)]
        pad[axis] = ((k - 1) // 2, k // 2)
        total = np.cumsum(np.pad(gradient, pad, "edge"), axis=axis)
        total = np.insert(total, 0, 0.0, axis=axis)
        n = gradient.shape[axis]
        gradient = (np.take(total, range(k, k + n), axis) - np.take(total, range(n), axis)) / k
    return gradient


@dataclass
class Costs:
    """Costs of a unit down or up across horizontal edges, and right or left across vertical ones."""

    down: np.ndarray
    up: np.ndarray
    right: np.ndarray
    left: np.ndarray


@functools.lru_cache(maxsize=8)
def _table(nlooks: float) -> CarballoTable:
    """The table of a look count (which it rounds to tenths), built once in a process."""
    return CarballoTable(nlooks)


def statistical_costs(phase, corr, mask, nlooks: float, window=(7, 7), table: CarballoTable | None = None) -> Costs:
    """Analytic costs from coherence and smoothed gradients; an edge that ends in the mask is free."""
    table = table or _table(round(looks(nlooks), 1))
    h, v = wrap(np.diff(phase, axis=1)), wrap(np.diff(phase, axis=0))
    ch, cv = np.minimum(corr[:, 1:], corr[:, :-1]), np.minimum(corr[1:], corr[:-1])
    down, up = arc_costs(table, ch, smooth(h, *window))
    left, right = arc_costs(table, cv, smooth(v, *window))
    free_h, free_v = ~(mask[:, 1:] & mask[:, :-1]), ~(mask[1:] & mask[:-1])
    down[free_h] = up[free_h] = 0
    left[free_v] = right[free_v] = 0
    return Costs(down, up, right, left)


def variance_costs(phase, variance, mask, scale: int = 100, most: int = 65535) -> Costs:
    """Costs from phase variances: what of pi the wrapped gradient leaves, over the variance of the difference."""
    var = np.where(variance > 0, np.clip(variance, 1e-3, 50), 50.0)
    price = lambda g, a, b, sign: np.minimum(np.rint(scale * np.maximum((np.pi - sign * g) / (a + b), 0)), most).astype(np.int64)
    h, v = wrap(np.diff(phase, axis=1)), wrap(np.diff(phase, axis=0))
    (ha, hb), (va, vb) = (var[:, :-1], var[:, 1:]), (var[:-1], var[1:])
    out = Costs(price(h, ha, hb, 1), price(h, ha, hb, -1), price(v, va, vb, -1), price(v, va, vb, 1))
    free_h, free_v = ~(mask[:, 1:] & mask[:, :-1]), ~(mask[1:] & mask[:-1])
    out.down[free_h] = out.up[free_h] = 0
    out.left[free_v] = out.right[free_v] = 0
    return out


def convex_costs(phase, corr, mask, nlooks: float, window=(7, 7)) -> tuple[np.ndarray, ...]:
    """Offset (hundredths of a cycle) and weight of horizontal, then of vertical edges; 0 where an end is masked."""
    out = []
    for axis in (1, 0):
        raw = wrap(np.diff(phase, axis=axis))
        low = np.minimum(np.delete(corr, 0, axis), np.delete(corr, -1, axis)).clip(1e-3, 0.999)
        both = np.delete(mask, 0, axis) & np.delete(mask, -1, axis)
        variance = (1 - low**2) / (2 * nlooks * low**2)
        # a unit of flow adds a cycle to the step, which should come out near the smoothed gradient
        offset = np.rint(100 * (smooth(raw, *window) - raw) / TAU)
        weight = np.rint(np.minimum(100 / np.maximum(variance, 1e-4), 1e7))
        out += [np.where(both, offset, 0).astype(np.int64), np.where(both, weight, 0).astype(np.int64)]
    return tuple(out)


def wiggle_cuts(phase, unw, corr, mask, nlooks: float, window=(7, 7), reliability: float = 0.5, thicken: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical edges that bound components: where a cycle more or less than ``unw`` has costs no more than
    ``reliability`` (in inverse variances), by the convex costs, or an end is masked; thickened across the edges."""
    offset_h, weight_h, offset_v, weight_v = convex_costs(phase, corr, mask, nlooks, window)
    threshold, out = round(reliability * 1e6), []  # a cost of 100 a variance, a cycle of 100 units
    for axis, offset, weight in ((1, offset_h, weight_h), (0, offset_v, weight_v)):
        both = np.delete(mask, 0, axis) & np.delete(mask, -1, axis)
        k = np.rint((np.diff(np.where(mask, unw, 0), axis=axis) - wrap(np.diff(phase, axis=axis))) / TAU).astype(np.int64)
        u = 100 * k - offset
        rel = weight * (10000 - 200 * np.abs(u))
        if not thicken:
            out.append(~both | (rel <= threshold))
            continue
        strength = np.where(both, np.maximum(threshold - rel, 0), max(threshold, 0))
        across = np.moveaxis(strength, 1 - axis, 0)
        total, n = 2 * across, np.full(across.shape, 2)
        total[1:], n[1:] = total[1:] + across[:-1], n[1:] + 1
        total[:-1], n[:-1] = total[:-1] + across[1:], n[:-1] + 1
        out.append(~both | np.moveaxis(2 * total >= n, 0, 1 - axis))
    return out[0], out[1]


def solve(supply: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Cycles ``(c_h, c_v)`` of least cost that balance the supply: successive shortest paths with potentials.

    Arcs are uncapacitated. Each unit goes along a shortest path in reduced costs, which keeps reduced costs
    non-negative, so the result is optimal whatever the order. The frame costs nothing to walk along, so it is one place:
    it first takes the excess that is nearer to it than to a deficit, and then gives to the deficits that are left,
    looked for from their side. No search goes on along or beyond the frame.
    """
    rows, cols = supply.shape
    n = rows * cols
    step = (cols, -cols, 1, -1)  # down, up, right, left
    cost = [np.zeros((rows, cols), np.int64) for _ in range(4)]
    cost[0][:-1, 1:-1], cost[1][1:, 1:-1] = costs.down, costs.up
    cost[2][1:-1, :-1], cost[3][1:-1, 1:] = costs.right, costs.left
    # arc k * n + u leaves u by step k; its price is what it costs now: undoing flow on the opposite arc earns that cost back
    c = np.concatenate([x.ravel() for x in cost]).tolist()
    back = (1, 0, 3, 2)
    inner = np.zeros((rows, cols), bool)
    inner[1:-1, 1:-1] = True
    frame = (~inner).ravel().tolist()
    to = [[(u + step[k], k * n + u, back[k] * n + u + step[k]) for k in range(4)] if not frame[u] else [] for u in range(n)]
    price, flow = list(c), [0] * (4 * n)
    rest = np.where(inner, supply, 0).ravel().tolist()
    potential = [0] * n
    none = 1 << 60
    dist, came = [none] * n, [0] * n
    bits = n.bit_length()
    low = (1 << bits) - 1
    push, pop = heapq.heappush, heapq.heappop
    for sign in (1, -1):  # from excess along arcs, then from deficits against them
        near = [[(v, b if sign < 0 else a) for v, a, b in x] for x in to]
        for start in [u for u, x in enumerate(rest) if sign * x > 0]:
            while sign * rest[start] > 0:
                dist[start], heap, seen, done = 0, [start], [start], []
                while True:  # the frame is always found
                    top = pop(heap)
                    d, u = top >> bits, top & low
                    if d > dist[u]:
                        continue
                    done.append(u)
                    if frame[u] or sign * rest[u] < 0:
                        break
                    d -= potential[u]
                    for v, a in near[u]:
                        total = d + price[a] + potential[v]
                        if total < dist[v]:
                            if dist[v] == none:
                                seen.append(v)
                            dist[v], came[v] = total, a
                            push(heap, total << bits | v)
                reach, end = dist[u], u
                for u in done:
                    potential[u] += reach - dist[u]
                for u in seen:
                    dist[u] = none
                u = end
                while u != start:
                    a = came[u]
                    k, tail = divmod(a, n)
                    b = back[k] * n + tail + step[k]
                    if flow[b] > 0:
                        flow[b] -= 1
                        if not flow[b]:
                            price[a] = c[a]
                    else:
                        flow[a] += 1
                        price[b] = -c[a]
                    u = tail if sign > 0 else tail + step[k]
                rest[start] -= sign
                if not frame[end]:
                    rest[end] += sign
        potential = [-x for x in potential]
    f = np.array(flow).reshape(4, rows, cols)
    c_h = f[0][:-1, 1:-1] - f[1][1:, 1:-1]
    c_v = f[3][1:-1, 1:] - f[2][1:-1, :-1]
    return c_h, c_v


def integrate(phase: np.ndarray, c_h: np.ndarray, c_v: np.ndarray) -> np.ndarray:
    """Cycles of each pixel, down column 0 and then along rows; any path gives the same once residues are balanced."""
    n_h = np.round((phase[:, :-1] - phase[:, 1:]) / TAU).astype(np.int64) + c_h
    n_v = np.round((phase[:-1] - phase[1:]) / TAU).astype(np.int64) + c_v
    k = np.zeros(phase.shape, np.int64)
    k[1:, 0] = np.cumsum(n_v[:, 0])
    k[:, 1:] = k[:, :1] + np.cumsum(n_h, axis=1)
    return k


def objective(costs: Costs, c_h: np.ndarray, c_v: np.ndarray) -> int:
    pay = lambda x, plus, minus: (np.maximum(x, 0) * plus + np.maximum(-x, 0) * minus).sum()
    return int(pay(c_h, costs.down, costs.up) + pay(c_v, costs.left, costs.right))


def label(mask: np.ndarray, cut_h: np.ndarray | None = None, cut_v: np.ndarray | None = None) -> np.ndarray:
    """4-connected components in raster order of their first pixel; cut edges do not connect."""
    m, n = mask.shape
    join_h = mask[:, 1:] & mask[:, :-1] & (True if cut_h is None else ~cut_h)
    join_v = mask[1:] & mask[:-1] & (True if cut_v is None else ~cut_v)
    own = np.where(mask, np.arange(m * n).reshape(m, n), m * n)
    while True:
        before = own.copy()
        for a, b, j in ((own[:, 1:], own[:, :-1], join_h), (own[1:], own[:-1], join_v)):
            low = np.minimum(a, b)
            a[j] = np.minimum(a[j], low[j])
            b[j] = np.minimum(b[j], low[j])
        flat = np.append(own.ravel(), m * n)
        own = np.where(mask, flat[own], m * n)
        if (own == before).all():
            break
    roots = np.unique(own[mask])
    return np.where(mask, np.searchsorted(roots, own) + 1, 0)


def bridge(unw: np.ndarray, labels: np.ndarray, min_px: int = 500, most: int = 2000, radius: int = 32) -> np.ndarray:
    """Regions moved by whole cycles so that each agrees with its nearest larger one around the nearest pair of pixels."""
    ids, size = np.unique(labels[labels > 0], return_counts=True)
    order = [i for s, i in sorted(zip(-size, ids, strict=True)) if -s >= min_px]
    if len(order) < 2:
        return unw
    out = unw.copy()
    edge = {}
    for r in order:
        inside = np.pad(labels == r, 1, "edge")
        rim = (labels == r) & ~(inside[:-2, 1:-1] & inside[2:, 1:-1] & inside[1:-1, :-2] & inside[1:-1, 2:])
        at = np.argwhere(rim)
        edge[r] = at[:: max(1, -(-len(at) // most))]
    box = min(radius, max(16, min(unw.shape) // 8))

    def median(r, at):
        a, b = np.maximum(at - box, 0), at + box + 1
        part = out[a[0] : b[0], a[1] : b[1]]
        return np.nanmedian(part[labels[a[0] : b[0], a[1] : b[1]] == r])

    for n, r in enumerate(order[1:], 1):
        best = None
        for p in order[:n]:
            if not len(edge[p]) or not len(edge[r]):
                continue
            for at in range(0, len(edge[r]), 256):
                own = edge[r][at : at + 256]
                d = ((own[:, None] - edge[p][None]) ** 2).sum(axis=2)
                i, j = np.unravel_index(d.argmin(), d.shape)
                if best is None or d[i, j] < best[0]:
                    best = (d[i, j], p, edge[p][j], own[i])
        if best is not None:
            _, p, there, here = best
            out[labels == r] -= TAU * np.rint((median(r, here) - median(p, there)) / TAU)
    return out


def goldstein(ifg: np.ndarray, alpha: float = 0.7, psize: int = 64) -> np.ndarray:
    """Adaptive spectral filter on overlapping patches, weighted by a Hann window; empty pixels stay empty."""
    if alpha < 0 or psize < 4 or psize % 2:
        raise ValueError("alpha must not be negative and psize must be even and at least 4")
    size = np.abs(ifg)
    unit = np.where(size > 0, ifg / np.where(size > 0, size, 1), 0)
    step = psize // 2
    pad = [(step, step + (step - d % step) % step) for d in ifg.shape]
    z = np.pad(unit, pad, "reflect")
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(psize) / (psize - 1)))
    weight = np.outer(hann, hann)
    out, total = np.zeros_like(z, complex), np.zeros(z.shape)
    for a in range(0, z.shape[0] - psize + 1, step):
        for b in range(0, z.shape[1] - psize + 1, step):
            f = np.fft.fft2(z[a : a + psize, b : b + psize])
            out[a : a + psize, b : b + psize] += np.fft.ifft2(f * np.abs(f) ** alpha) * weight
            total[a : a + psize, b : b + psize] += weight
    out = np.where(total > 0, out / np.where(total > 0, total, 1), 0)[step : step + ifg.shape[0], step : step + ifg.shape[1]]
    return np.where(size > 0, out, 0)


def interpolate(ifg: np.ndarray, weight: np.ndarray, cutoff: float = 0.5, neighbours: int = 30, most: int = 101, least: int = 0, alpha: float = 0.75) -> np.ndarray:
    """Phase of pixels below the cutoff from their nearest neighbours at or above it, the nearer the heavier."""
    span = np.arange(-most + 1, most)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    r2 = dy**2 + dx**2
    near = (r2 < most**2) & (r2 > least**2)
    order = np.argsort(r2[near], kind="stable")
    dy, dx, r2 = dy[near][order], dx[near][order], r2[near][order]
    out = ifg.copy()
    m, n = ifg.shape
    for i, j in np.argwhere((weight < cutoff) & (np.abs(ifg) > 0)):
        a, b = i + dy, j + dx
        inside = (a >= 0) & (a < m) & (b >= 0) & (b < n)
        at = np.flatnonzero(inside)
        good = at[weight[a[at], b[at]] >= cutoff][:neighbours]
        if not len(good):
            out[i, j] = abs(ifg[i, j])
            continue
        w = np.exp(-r2[good] / (r2[good][-1] ** alpha / 2))
        z = ifg[a[good], b[good]]
        total = (w * z / np.maximum(np.abs(z), 1e-30)).sum()
        out[i, j] = abs(ifg[i, j]) * np.exp(1j * np.angle(total))
    return out

"""Temporal closure of interferogram stacks ``(e, i, j, unw)`` over a graph of dates.

The graph is small (one row per interferogram) and handled on the driver; everything per pixel is a DataFrame plan with
the tree paths, cycles and triangles broadcast, whose size is that of the graph.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isophase.functions.phase import TAU, cycles


@dataclass(frozen=True)
class TemporalGraph:
    """Edges ``e: (from_date, to_date)`` over dates ``0..n_dates-1``; self loops and unknown dates are errors."""

    n_dates: int
    edges: tuple[tuple[int, int], ...]

    def __post_init__(self) -> None:
        for a, b in self.edges:
            if a == b or not (0 <= a < self.n_dates and 0 <= b < self.n_dates):
                raise ValueError(f"edge {a}-{b} is not between two known dates")

    def spanning_tree(self, reference: int = 0, priority: list[float] | None = None) -> dict[int, tuple[int, int, int]]:
        """``date: (parent, edge, sign)``, grown from the reference by the best (lowest) priority, then the lowest date."""
        cost = priority or [1.0] * len(self.edges)
        near: dict[int, list[tuple[int, int, int]]] = {d: [] for d in range(self.n_dates)}
        for e, (a, b) in enumerate(self.edges):
            near[a].append((b, e, 1))
            near[b].append((a, e, -1))
        best: dict[int, tuple[float, int, int, int]] = {}
        tree: dict[int, tuple[int, int, int]] = {}
        heap, done = [(float("-inf"), reference)], set()
        while heap:
            c, d = heapq.heappop(heap)
            if d in done or (d != reference and best[d][0] != c):
                continue
            done.add(d)
            if d != reference:
                tree[d] = best[d][1:]
            for to, e, sign in near[d]:
                if to not in done and (to not in best or cost[e] < best[to][0]):
                    best[to] = (cost[e], d, e, sign)
                    heapq.heappush(heap, (cost[e], to))
        if len(done) < self.n_dates:
            raise ValueError("the graph of dates is not connected")
        return tree

    def paths(self, reference: int = 0, priority: list[float] | None = None) -> list[tuple[int, int, int]]:
        """``(date, edge, sign)`` for the edges from the reference to each date."""
        tree = self.spanning_tree(reference, priority)
        out = []
        for date in tree:
            d = date
            while d in tree:
                parent, e, sign = tree[d]
                out.append((date, e, sign))
                d = parent
        return out

    def cycles(self, reference: int = 0, priority: list[float] | None = None) -> list[tuple[int, int, int]]:
        """``(cycle, edge, sign)`` of the fundamental cycles: each edge beside the tree, against the tree path between its dates."""
        tree = self.spanning_tree(reference, priority)
        used = {e for _, e, _ in tree.values()}
        path: dict[int, dict[int, int]] = {}
        for date, e, sign in self.paths(reference, priority):
            path.setdefault(date, {})[e] = sign
        out, n = [], 0
        for e, (a, b) in enumerate(self.edges):
            if e in used:
                continue
            total: dict[int, int] = {}
            for way, s in ((path.get(b, {}), 1), (path.get(a, {}), -1)):
                for k, sign in way.items():
                    total[k] = total.get(k, 0) + s * sign
            out += [(n, k, s) for k, s in sorted(total.items()) if s]
            out.append((n, e, -1))
            n += 1
        return out

    def triangles(self) -> list[tuple[int, int, int]]:
        """``(triangle, edge, sign)`` for dates a < b < c with all three edges; of edges between two dates the last counts."""
        of = {}
        for e, (a, b) in enumerate(self.edges):
            of[min(a, b), max(a, b)] = (e, 1 if a < b else -1)
        out, n = [], 0
        for a in range(self.n_dates):
            for b in range(a + 1, self.n_dates):
                for c in range(b + 1, self.n_dates):
                    if (a, b) in of and (b, c) in of and (a, c) in of:
                        out += [(n, *of[a, b]), (n, *of[b, c]), (n, of[a, c][0], -of[a, c][1])]
                        n += 1
        return out


def closure_correct(stack: DataFrame, graph: TemporalGraph, reference: int = 0, priority: list[float] | None = None) -> DataFrame:
    """``(e, i, j, k, corrected)``: edges beside the tree made to agree with the dates' phases along the tree."""
    spark = stack.sparkSession
    used = {e for _, e, _ in graph.spanning_tree(reference, priority).values()}
    signs: dict[tuple[int, int], int] = {}
    for date, e, sign in graph.paths(reference, priority):
        signs[date, e] = sign
    rows = []
    for x, (a, b) in enumerate(graph.edges):
        for e in range(len(graph.edges)):
            s = signs.get((b, e), 0) - signs.get((a, e), 0)
            if s and x not in used:
                rows.append((x, e, s))
    along = spark.createDataFrame(rows, "x int, e int, s int")
    predicted = stack.join(along, "e").groupBy("x", "i", "j").agg(F.sum(F.col("s") * F.col("unw")).alias("p")).withColumnRenamed("x", "e")
    out = stack.join(predicted, ["e", "i", "j"], "left")
    k = F.coalesce(cycles(F.col("unw") - F.col("p")), F.lit(0)).cast("int")
    return out.select("e", "i", "j", k.alias("k"), (F.col("unw") - F.lit(TAU) * k).alias("corrected"))


def _most_cycles(stack: DataFrame, members: list[tuple[int, int, int]]) -> DataFrame:
    loops = stack.sparkSession.createDataFrame(members, "c int, e int, s int")
    k = stack.join(loops, "e").groupBy("i", "j", "c").agg(cycles(F.sum(F.col("s") * F.col("unw"))).alias("k"))
    return k.groupBy("i", "j").agg(F.max(F.abs("k")).cast("int").alias("quality"))


def cycle_quality(stack: DataFrame, graph: TemporalGraph) -> DataFrame:
    """``(i, j, quality)``: the most whole cycles that any fundamental cycle misses closure by."""
    return _most_cycles(stack, graph.cycles())


def triangle_quality(stack: DataFrame, graph: TemporalGraph) -> DataFrame:
    return _most_cycles(stack, graph.triangles())


def closure_refine(stack: DataFrame, graph: TemporalGraph, crlb: DataFrame, max_iter: int = 32) -> DataFrame:
    """Greedy refinement per pixel: ``(i, j, corrected, violations, iterations)`` with ``corrected`` an array by edge.

    ``crlb(e, i, j, variance)`` tells where to route: the cycle with the largest violation gives it to its edge with
    the largest variance (first ones on ties). Pixels are independent, so they are refined in Arrow batches.
    """
    loops = np.zeros((1 + max((c for c, _, _ in graph.cycles()), default=-1), len(graph.edges)))
    for c, e, s in graph.cycles():
        loops[c, e] = s
    n = len(graph.edges)
    cube = stack.join(crlb, ["e", "i", "j"], "left").groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("e", "unw", F.coalesce("variance", F.lit(0.0)).alias("variance")))).alias("v"))
    cube = cube.select("i", "j", F.transform("v", lambda x: x["unw"]).alias("y"), F.transform("v", lambda x: x["variance"]).alias("var")).where(F.size("y") == n)

    def work(batches):
        for batch in batches:
            y = np.array(batch.column(2).to_pylist(), float).reshape(-1, n)
            var = np.array(batch.column(3).to_pylist(), float).reshape(-1, n)
            done = np.zeros(len(y), np.int64)
            live = np.arange(len(y)) if len(loops) else np.empty(0, int)
            for _ in range(max_iter):
                miss = np.rint(y[live] @ loops.T / TAU)
                worst = np.abs(miss).argmax(axis=1) if len(live) else np.empty(0, int)
                some = np.abs(miss).max(axis=1, initial=0) > 0
                live, worst, miss = live[some], worst[some], miss[some]
                if not len(live):
                    break
                member = loops[worst]
                edge = np.where(member != 0, var[live], -np.inf).argmax(axis=1)
                at = np.arange(len(live))
                y[live, edge] -= TAU * miss[at, worst] * member[at, edge]
                done[live] += 1
            left = (np.rint(y @ loops.T / TAU) != 0).sum(axis=1) if len(loops) else np.zeros(len(y), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(y), pa.list_(pa.float64())), pa.array(left.astype(np.int32)), pa.array(done.astype(np.int32))], names=["i", "j", "corrected", "violations", "iterations"])

    i, j = (dict(cube.dtypes)[c] for c in "ij")
    return cube.mapInArrow(work, f"i {i}, j {j}, corrected array<double>, violations int, iterations int")


def triplets(dates: int, family: str) -> list[tuple[int, int, int]]:
    """Triplets of dates: ``short`` of three in a row, ``long`` of the first one and two in a row after it."""
    if family == "long":
        return [(0, i, i + 1) for i in range(1, dates - 1)]
    if family == "short":
        return [(i, i + 1, i + 2) for i in range(dates - 2)]
    raise ValueError(f"unknown family {family!r}")


def triplet_closure(stack: DataFrame, dates: int, family: str) -> DataFrame:
    """``(a, b, c, n, pct_k_closure, pct_true_any, wrapped_p95)`` of each triplet of ``stack(from_date, to_date, i, j, psi,
    unw, k_error)``.

    Per pixel with all three phases: the cycles by which the unwrapped closure is off the wrapped one, and whether any of
    the three has an ambiguity error; shares in percent and the 95th percentile of the wrapped closure's size.
    """
    rows = [(a, b, c) for a, b, c in triplets(dates, family)]
    wanted = stack.sparkSession.createDataFrame(rows, "a int, b int, c int")
    side = wanted.select("a", "b", "c", F.explode(F.array(*(F.struct(F.col(x).alias("from_date"), F.col(y).alias("to_date"), F.lit(s).alias("s")) for x, y, s in (("a", "b", 1), ("b", "c", 1), ("a", "c", -1))))).alias("e")).select("a", "b", "c", "e.*")
    met = stack.where(F.col("unw").isNotNull() & ~F.isnan("unw")).join(side, ["from_date", "to_date"])
    per = met.groupBy("a", "b", "c", "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("psi")).alias("psi"), F.sum(F.col("s") * F.col("unw")).alias("unw"), F.max((F.col("k_error") != 0).cast("int")).alias("wrong"))
    per = per.where("n = 3").withColumn("mis", F.col("psi") - F.lit(TAU) * F.round(F.col("psi") / TAU))
    off = (F.round((F.col("unw") - F.col("mis")) / TAU) != 0).cast("int")
    return per.groupBy("a", "b", "c").agg(
        F.count("*").alias("n"), (100 * F.avg(off)).alias("pct_k_closure"), (100 * F.avg("wrong")).alias("pct_true_any"), F.percentile(F.abs("mis"), F.lit(0.95)).alias("wrapped_p95")
    )

"""SimHash near-dedup with vantage-point trees.

Fingerprints within ``RADIUS`` bits of each other are linked; a component is a set of documents reachable by links.

Method: distinct fingerprints are routed through vantage-point trees. A node's vantage point is one of its fingerprints,
chosen by hash; the node is split at the median Hamming distance to it, which a histogram of the at most 65 distances
gives; a fingerprint within ``RADIUS`` below the split is also sent across it, so by the triangle inequality every linked
pair meets in some shard. Distances between random 64-bit fingerprints crowd around 32, where such bounds prune little (a
level leaves 0.7 of a shard and repeats 0.4 of it). So after ``LEVELS`` levels the branches are keyed by blocks of the bits
too: fingerprints that differ in at most ``RADIUS`` of ``m`` blocks agree in ``m - RADIUS`` of them, which is a distance of
zero there; ``m`` grows with the number of fingerprints, so that shards of unrelated ones stay small. Shards above
``SHARD`` go on being split by vantage points in Spark. In a shard, a local tree goes on until its leaves are small and
compares there exactly. A shard returns a spanning forest of its links, never all pairs, and components are joined by
star contraction in Spark.

A cluster whose fingerprints are all so close together that no vantage point parts it is dealt out in chunks of ``SHARD``,
each pair of which is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key
from .components import connected_components

#: Words in a shingle (of the query, of the pipeline's stage), hash seed, and the most bits in which linked fingerprints differ.
SHINGLE, STAGE_SHINGLE, SEED, RADIUS = 4, 5, 42, 4
BITS = 64
#: Levels of vantage points above the blocks; most fingerprints of a shard, and of a leaf of its local tree; a split that
#: leaves more than this share of a shard on one side is none.
LEVELS, SHARD, LEAF, PARTED = 2, 1 << 15, 256, 0.9


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64; no words give zero."""
    words = body.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(text, SEED)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    a, b = start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    votes, n = np.zeros(BITS, np.int64), len(a)
    for i in range(0, n, 1 << 16):
        own = slice(i, i + (1 << 16))
        h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(a[own], b[own], strict=True)), ">u8", len(a[own]))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in batch.column(3)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(fp.view(np.int64))], names=["doc_id", "k1", "k2", "fp"])

    return work


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, k1, k2, fp)`` per row of ``docs``; a null text counts as empty."""
    doc, text = F.col("doc_id").cast("long"), F.col("text")
    return docs.select(doc.alias("doc_id"), *row_key(doc, text), text.cast("binary").alias("body")).mapInArrow(_fingerprints(shingle), "doc_id long, k1 long, k2 long, fp long")


def blocks_for(n: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """Fewest blocks of the bits such that ``n`` random fingerprints have about ``shard`` or fewer that agree in all but ``radius``."""
    m = radius + 1
    while m < BITS and n / 2 ** (BITS * (m - radius) / m) > shard:
        m += 1
    return m


def block_keys(m: int, radius: int = RADIUS) -> list[Column]:
    """A key for each choice of ``m - radius`` blocks: the bits of ``fp`` in them."""
    edge = [round(i * BITS / m) for i in range(m + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    chosen = [sum(mask[i] for i in c) for c in combinations(range(m), m - radius)]
    return [F.xxhash64("shard", F.lit(i), F.col("fp").bitwiseAND(F.lit(x - (1 << BITS) if x >> (BITS - 1) else x).cast("long"))) for i, x in enumerate(chosen)]


def _level(rows: DataFrame, radius: int, most: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One level of vantage points for the shards of ``rows(shard, fp)`` with over ``most`` fingerprints.

    Gives the rows of the other shards, the two sides of those that were split, and the rows of those that no vantage
    point parts with their number ``n``; None if no shard is that large.
    """
    size = materialize(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most))
    if size.isEmpty():
        return None
    large = rows.join(size, "shard")
    point = large.groupBy("shard").agg(F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), "fp")).alias("v")).select("shard", F.col("v.fp").alias("v"))
    placed = materialize(large.join(materialize(point), "shard").select("shard", "fp", "n", F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))).alias("d")))
    by = Window.partitionBy("shard").orderBy("d")  # at most 65 rows of a shard
    spread = placed.groupBy("shard", "n", "d").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(by))
    middle = spread.groupBy("shard", "n").agg(F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("d"))).alias("mu"), F.collect_list(F.struct("d", "c")).alias("all"))
    above = F.aggregate(F.filter("all", lambda x: x["d"] >= F.col("mu") - radius), F.lit(0).cast("long"), lambda t, x: t + x["c"])
    plan = materialize(middle.select("shard", "mu", (above <= F.col("n") * PARTED).alias("parted")))
    known = placed.join(plan, "shard")
    near, far = F.col("d") < F.col("mu"), F.col("d") >= F.col("mu") - radius
    sides = F.filter(F.array(F.when(near, 0), F.when(far, 1)), lambda x: x.isNotNull())
    split = known.where("parted").select(F.col("shard").alias("of"), "fp", F.explode(sides).alias("side")).select(F.xxhash64("of", "side").alias("shard"), "fp")
    return rows.join(size, "shard", "left_anti"), split, known.where("not parted").select("shard", "fp", "n")


def shards(fps: DataFrame, radius: int = RADIUS, levels: int = LEVELS, most: int = SHARD) -> DataFrame:
    """``(shard, fp)``: every fingerprint of the distinct ones ``fps(fp)`` in each shard that it belongs to or borders on."""
    rows = materialize(fps.select(F.lit(0).cast("long").alias("shard"), "fp"))  # a constant would make the joins nested loops
    for turn in range(levels):
        got = _level(rows, radius, LEAF, turn)
        if got is None:
            break
        rows = materialize(got[0].union(got[1]).union(got[2].select("shard", "fp")))
    m = blocks_for(fps.count(), radius, most)
    rows = materialize(rows.select(F.explode(F.array(*block_keys(m, radius))).alias("shard"), "fp"))
    done, turn = [], levels
    while (got := _level(rows, radius, most, turn)) is not None:
        done.append(materialize(got[0]))
        chunks = F.ceil(F.col("n") / most)
        own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
        pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.xxhash64("shard", F.least(own, j), F.greatest(own, j)))
        done.append(materialize(got[2].select(F.explode(pairs).alias("shard"), "fp")))
        rows, turn = materialize(got[1]), turn + 1
    for part in done:
        rows = rows.union(part)
    return rows


def _spanning(pairs: Iterator[tuple[int, int]], fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that leave no component apart and close no circle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(fps[i]), int(fps[j])))
    return out


def local_links(fps: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints (uint64), by a vantage-point tree."""
    todo, out = [fps], []
    while todo:
        x = todo.pop()
        if len(x) < 2:
            continue
        if len(x) <= leaf:
            i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
            if len(i):
                out += _spanning(zip(i.tolist(), j.tolist(), strict=True), x)
            continue
        d = np.bitwise_count(x ^ x[0]).astype(np.int16)
        mu = int(np.median(d))
        below, above = x[d < mu], x[d >= mu - radius]
        if len(above) > PARTED * len(x):
            out += _sweep(x, radius)
        else:
            todo += [below, above]
    return out


def _sweep(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Grow components from a frontier; a cluster that no split can part is left after few comparisons."""
    out, rest = [], x
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            u = frontier.pop()
            near = np.bitwise_count(rest ^ u) <= radius
            if near.any():
                out += [(int(u), int(v)) for v in rest[near]]
                frontier += list(rest[near])
                rest = rest[~near]
    return out


def _links(radius: int):
    def close(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        return local_links(np.unique(np.concatenate(parts)), radius)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if held and keys[a] != shard:
                    out += close(held)
                    held = []
                shard = keys[a]
                held.append(fps[a:b])
            yield _edges(out)
        if held:
            yield _edges(close(held))

    return work


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def link_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(node, root)`` of the distinct fingerprints ``fps(fp)`` that have a link."""
    dealt = shards(fps, radius)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = dealt.repartition(n, "shard").sortWithinPartitions("shard").select("shard", "fp").mapInArrow(_links(radius), "a long, b long")
    return connected_components(links)


def row_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, k1, k2, fp, root)`` per row of ``docs``: rows with one ``root``, a fingerprint, are one component."""
    own = materialize(fingerprints(docs, shingle))
    distinct = materialize(own.select("fp").distinct())
    comp = distinct.join(link_components(distinct, radius), F.col("fp") == F.col("node"), "left")
    comp = materialize(comp.select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root")))
    return own.join(comp, F.col("fp") == F.col("f")).select("doc_id", "k1", "k2", "fp", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, fingerprint, component_id``.

    Words are lower-cased (A-Z); a text of fewer than ``shingle`` words is one shingle; one without words, or null, has
    fingerprint zero and links like any other. ``component_id`` is the smallest non-null id of the component, null if
    it has none. Repeated rows stay; other columns are not looked at; an empty table gives an empty result.
    """
    rows = materialize(row_components(docs, shingle, radius))
    low = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(low, "root").select("doc_id", text.alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id (null last) and, among different texts
    of that id, the one with the smallest name. Of rows with the same id and text one stays, any of them if others differ.

    A group is what links of fingerprints of ``STAGE_SHINGLE``-word shingles within ``RADIUS`` bits connect, by the operator
    above. That finds copies with few edits; the README has the share of near copies that it misses.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    rows = row_components(docs, STAGE_SHINGLE)
    keep = materialize(rows.groupBy("root").agg(F.min(order).alias("low")).select("low.k1", "low.k2"))
    inner = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("text")))
    # rows of one name are the same document: all but one of them go, which a partial aggregation does before the shuffle
    content = F.xxhash64(*(F.col("row")[c].cast("string") for c in docs.columns))
    return inner.join(keep, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by("row", content).alias("row")).select("row.*")

"""The rounds of prefix doubling, the paths of the graph, and rows that share an id."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isophase.llm import debruijn, suffix_dedup
from isophase.llm.minimisers import covered


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def noise(rng, n):
    return "".join(rng.choice("abcdefghij") for _ in range(n))


def test_offsets_grow_to_the_threshold():
    places = suffix_dedup.offsets()
    assert places[-1] == 0 and places == sorted(places, reverse=True)
    shared = [max(0, 160 - ((1 << p) - 1)) + 40 for p in places]  # bytes that all strings of the first block share
    assert shared == sorted(shared) and shared[-1] == 200


@pytest.mark.parametrize("step", [1, 2, 8])
def test_rounds_sort_fewer_positions_than_bytes_and_lose_no_string(spark, step):
    """Texts around one minimiser that part at every distance from it."""
    rng = random.Random(step)
    core, left, right = "K" * 40, noise(rng, 170), noise(rng, 170)
    texts = []
    for i in range(60):
        a, b = rng.randint(0, 160), rng.randint(0, 160)
        texts.append((noise(rng, 160 - a) + left[170 - a :] + core + right[:b] + noise(rng, 160 - b), i))
    rows = [(7, i, i, i, 1, 0, 160, 0, 160, t.encode()) for t, i in texts]
    strings = spark.createDataFrame(rows, suffix_dedup._STRINGS)
    ranges, sizes = suffix_dedup.doubling(strings, step=step)
    count = Counter(t[160 - a : 360 - a] for t, _ in texts for a in range(161))
    want = {(i, 160 - a) for t, i in texts for a in range(161) if count[t[160 - a : 360 - a]] > 1}
    got = {(r.k1, x) for r in ranges.collect() for x in range(r.lo, r.hi + 1)}
    assert got == want and want
    assert len(sizes) == -(-8 // step)
    assert sum(sizes) < 60 * 161 * 2 and (step == 8 or sizes[0] <= 60 * 2**step)


def test_a_round_lets_unique_positions_leave(spark):
    """Two texts share only 40 bytes: after the first round nothing is left to rank."""
    rng = random.Random(4)
    rows = [(7, i, i, i, 1, 0, 160, 0, 160, (noise(rng, 160) + "K" * 40 + noise(rng, 160)).encode()) for i in range(2)]
    ranges, sizes = suffix_dedup.doubling(spark.createDataFrame(rows, suffix_dedup._STRINGS))
    assert ranges.count() == 0 and sizes[0] > 0 and not any(sizes[1:])


def test_unitigs_end_where_copies_part(spark):
    """Three texts share a middle: the shared edges are paths whose ends are where the texts part, edges of one text leave."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    middle, tail = words(30), words(20)
    texts = [words(10) + middle + tail, words(10) + middle + words(20), middle + tail]
    edges = []
    for d, t in enumerate(texts):
        names = [hash(tuple(t[i : i + 5])) for i in range(len(t) - 4)]
        nodes = [hash(tuple(t[i : i + 4])) for i in range(len(t) - 3)]
        heads = [hash((9, *t[i : i + 4])) for i in range(len(t) - 3)]
        edges += [(nodes[i], heads[i + 1], d, d, 0, i) for i in range(len(names))]
    df = spark.createDataFrame(edges, "from_node long, to_node long, place long, s1 long, s2 long, at int")
    placed = debruijn.unitigs(debruijn.graph(df)).collect()
    seen = Counter(e[:2] for e in edges)
    assert {(r.from_node, r.to_node) for r in placed} == {e for e, n in seen.items() if n > 1}
    paths = {}
    for r in placed:
        paths.setdefault((r.s1, r.path), []).append(r.at)
    assert all(sorted(v) == list(range(min(v), max(v) + 1)) for v in paths.values())
    starts = {s for d, s in paths if d == 0}
    assert starts == {10}  # the middle and the tail after it: only one repeated edge follows another
    branch = df.where("s1 <> 0 or at < 1000").union(df.where("s1 = 1").withColumn("s1", F.lit(4)).withColumn("place", F.lit(4)))
    starts = {r.path for r in debruijn.unitigs(debruijn.graph(branch)).collect() if r.s1 == 0}
    assert starts == {10, 10 + 30 - 4}  # once the second text is repeated too, two edges leave the node after the middle
    small = debruijn.unitigs(debruijn.graph(df), block=4).collect()
    assert {(r.s1, r.at) for r in small} == {(r.s1, r.at) for r in placed}
    assert all(r.at // 4 == r.path // 4 for r in small)


def test_spans_that_differ_from_their_source_do_not_count(spark):
    docs = table(spark, [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"a{i}" for i in range(60))), (3, " ".join(f"b{i}" for i in range(60)))])
    body = debruijn.keyed(docs)
    keys = {r.doc_id: (r.k1, r.k2) for r in body.collect()}
    claimed = [(*keys[2], 0, 10, *keys[1], 0), (*keys[3], 0, 10, *keys[1], 0)]
    spans = spark.createDataFrame(claimed, "k1 long, k2 long, lo int, hi int, s1 long, s2 long, at int")
    assert [(r.k1, r.k2) for r in debruijn.verified(body, spans).collect()] == [keys[2]]


def test_null_ids_whose_texts_share_a_32_bit_hash(spark):
    """Different texts of equal 32-bit hash and null id are different rows."""
    rows = spark.range(200_000).select(F.concat(F.lit("plain words "), "id").alias("text")).withColumn("h", F.hash("text"))
    pair = rows.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").first()
    filler = " ".join(f"u{i}" for i in range(80))
    texts = [pair.a, pair.b, f"{filler} x", f"{filler} y", None, ""]
    docs = table(spark, [(None, t) for t in texts])
    got = {r.n_bytes: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[len(pair.a)] == got[len(pair.b)] == 0 and got[0] == 0
    assert got[len(filler) + 2] == len(filler) + 1
    words = [(r.n_words, r.n_removed) for r in debruijn.substring_dedup(docs).collect()]
    assert sorted(words) == [(0, 0), (0, 0), (3, 0), (3, 0), (81, 0), (81, 0)]


def test_empty_tables_and_stage_columns(spark):
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
    assert debruijn.substring_dedup(table(spark, [])).count() == 0
    long = "x" * 10 + noise(random.Random(1), 300)
    docs = spark.createDataFrame([(1, long, 310, "r", 5, 6), (1, "z" + long, 311, "q", 5, 6), (None, None, None, None, None, None), (1, long[:50], 50, "s", 5, 6)], "doc_id long, text string, n_chars int, row string, k1 long, kept long")
    got = suffix_dedup.stage_suffix_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.row or "", r.text, r.n_chars, r.k1) for r in got.collect()) == [("", None, None, None), ("q", "z", 1, 5), ("r", "", 0, 5), ("s", long[:50], 50, 5)]


def test_covered():
    import numpy as np

    assert covered(np.array([5, 0, 30, 6]), np.array([5, 2, 30, 9]), 3, 31) == [(0, 12), (30, 31)]

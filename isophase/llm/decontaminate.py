"""Benchmark decontamination: n-gram seeds, rare ones first, then Smith-Waterman alignment.

Words are lower-cased runs of letters, digits and bytes beyond ASCII. Seeds are four words of a test item, consecutive or
with gaps, so that copies with every third word changed still have some. They are looked up in every training text. A seed
that is in at most ``RARE`` items points at the item by itself; a common one (a question's stem) only if the text has enough
of the item's words at all. Around a seed, a copy can only be where a stretch of the text has enough of the item's words:
an alignment of ``COPY`` of the best score over n words needs ``COPY * n`` equal words within ``(3 - 2 * COPY) * n`` words of
the text. Both tests lose nothing. What passes is aligned with the whole item, word by word, so that copies with words
changed, inserted or left out score too. The benchmark is the small side: its seeds are broadcast up to ``MOST_WORDS`` words
and, beyond, the items are handled in blocks of that size, each against all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key

#: Places of a seed's words; most items that a rare seed is in.
PATTERNS, RARE = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 4, 5), (0, 2, 3, 5)), 20
#: Alignment: points for equal words, for a changed word, and for a word left out or put in.
MATCH, CHANGE, GAP = 2, -1, -1
#: Share of an item's best possible points from which a passage counts as a copy; shortest such stretch in words.
COPY, LEAST_WORDS = 0.5, 8
#: Benchmark words in a block; each has a seed of 16 bytes for every pattern.
MOST_WORDS = 1_000_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_TABLE).split()


@dataclass
class Items:
    """Test items as word numbers; their seeds' names, sorted, and the (item, place) of seed k in ``[first[k], first[k + 1])``."""

    number: dict[bytes, int]
    words: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sizes: list[int]
    ids: list[int]

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Items:
        number: dict[bytes, int] = {}
        words, found = [], []
        for item, (_, body) in enumerate(rows):
            ids = np.array([number.setdefault(w, len(number) + 1) for w in words_of(body)], np.int64)
            words.append(ids)
            for pattern in patterns_for(len(ids)):
                gram = _grams(ids, pattern)
                found.append((gram, np.full(len(gram), item, np.int32), np.arange(len(gram), dtype=np.int32)))
        gram, item, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        return Items(number, words, grams, np.append(first, len(gram)), item[order], place[order], sorted({len(w) for w in words if 0 < len(w) < len(PATTERNS[0])}), [item for item, _ in rows])

    def numbers(self, body: bytes) -> np.ndarray:
        """A text's words as the items' word numbers; 0 for words that no item has."""
        get = self.number.get
        return np.array([get(w, 0) for w in words_of(body)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, text position and whether the seed is rare, for all seeds in a text, sorted by item and position."""
        at, seed = [], []
        for pattern in (*PATTERNS, *(tuple(range(n)) for n in self.sizes)):
            gram = _grams(ids, pattern)
            if not len(gram) or not len(self.grams):
                continue
            known = np.flatnonzero(np.logical_and.reduce([ids[p : p + len(gram)] > 0 for p in pattern]))
            near = np.minimum(np.searchsorted(self.grams, gram[known]), len(self.grams) - 1)
            ok = self.grams[near] == gram[known]
            at.append(known[ok])
            seed.append(near[ok])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        at, seed = np.concatenate(at), np.concatenate(seed)
        many = self.first[seed + 1] - self.first[seed]
        run = np.repeat(np.arange(len(at)), many)
        item = self.item[self.first[seed][run] + np.arange(len(run)) - (np.cumsum(many) - many)[run]]
        order = np.lexsort((at[run], item))
        return item[order], at[run][order], (many <= RARE)[run][order]


def patterns_for(n: int) -> tuple[tuple[int, ...], ...]:
    """Seeds of an item of ``n`` words; one of fewer than four words is looked up whole."""
    return tuple(p for p in PATTERNS if p[-1] < n) or ((tuple(range(n)),) if n else ())


def _grams(ids: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """64-bit names of the words at ``pattern`` from every position on."""
    size = len(ids) - pattern[-1]
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, int.from_bytes(bytes(pattern), "big"), np.uint64)
    for i in pattern:
        out = (out ^ ids[i : i + size].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score, and the text's first word and the word after the last of that stretch."""
    if not len(item) or not len(text):
        return 0, 0, 0
    n = len(text)
    col = np.arange(1, n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(text == w, MATCH, CHANGE)
        above = score[1:] + GAP
        new = np.maximum(np.maximum(diagonal, above), 0)
        begin = np.where(new == 0, col, np.where(diagonal >= above, start[:-1], start[1:]))
        # words put into the text: a running maximum of score - GAP * column
        lifted = np.concatenate(([0], new)) - GAP * np.arange(n + 1)
        top = np.maximum.accumulate(lifted)
        filled = top + GAP * np.arange(n + 1)
        begin = np.concatenate(([0], begin))
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        score, start = filled, begin[source]
        at = int(np.argmax(score))
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def stretches(at: np.ndarray, reach: int, n: int, most: int) -> list[tuple[int, int]]:
    """The text within ``reach`` words of the positions, overlapping parts joined up to ``most`` words; each part holds all
    of what its positions reach."""
    out: list[list[int]] = []
    for p in at.tolist():
        a, b = max(0, p - reach), min(n, p + reach)
        if out and a <= out[-1][1] and b - out[-1][0] <= most:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def can_hold(inside: np.ndarray, least: float, reach: int) -> bool:
    """Whether ``reach`` words in a row have ``least`` of an item's words."""
    total = np.concatenate(([0], np.cumsum(inside)))
    return bool((total[reach:] - total[:-reach]).max() >= least) if len(inside) >= reach else total[-1] >= least


def copies(items: Items, body: bytes, share: float = COPY) -> list[tuple[int, float, int, int]]:
    """``(item, share of its best score, first word, end word)`` of the items that a text holds a copy of."""
    ids = items.numbers(body)
    item, at, rare = items.hits(ids)
    out = []
    cut = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = items.words[item[x]]
        n = len(own)
        known = np.unique(own)
        if not rare[x:y].any() and np.isin(ids, known).sum() < share * n:
            continue
        reach = int(np.ceil((3 - 2 * share) * n))
        best = (0.0, 0, 0)
        for a, b in stretches(at[x:y], reach, len(ids), 16 * n):
            if can_hold(np.isin(ids[a:b], known), share * n, reach):
                score, first, end = align(own, ids[a:b])
                best = max(best, (score / (MATCH * n), -(a + first), -(a + end)))
        first, end = -best[1], -best[2]
        if best[0] >= share and end - first >= min(LEAST_WORDS, n):
            out.append((int(item[x]), best[0], first, end))
    return out


def _align_texts(items, n_keys: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, text in enumerate(batch.column(n_keys)) for x in copies(items.value, text.as_py() or b"")]
            rows, number, *cols = list(zip(*found, strict=True)) or [()] * 5
            take = pa.array(rows, pa.int64())
            keys = [batch.column(k).take(take) for k in range(n_keys)]
            made = [pa.array([items.value.ids[i] for i in number], pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int64(), pa.int64()), strict=True))]
            yield pa.RecordBatch.from_arrays([*keys, *made], names=[*batch.schema.names[:n_keys], "item_id", "score", "first_word", "end_word"])

    return work


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), block: int = MOST_WORDS) -> DataFrame:
    """``(*keys, item_id, score, first_word, end_word)``: the texts of ``docs(*keys, text, ...)`` that hold a copy of a test item.

    ``score`` is the alignment's share of the item's best score, at least ``COPY``; the words are the copy's place in
    the text (the best one). One row per document row and item; an item id with several texts gives the best of them
    each. An item without words, a null text or item and an empty table give no row. Items of fewer than four words are
    looked up whole. Other columns are not looked at.
    """
    spark = docs.sparkSession
    own = docs.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col("text").cast("binary").alias("body")).where("body is not null")
    schema = ", ".join(f"{k} long" for k in keys) + ", item_id long, score double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for rows in _blocks(benchmark, block):
        out = out.unionByName(own.mapInArrow(_align_texts(spark.sparkContext.broadcast(Items.of(rows)), len(keys)), schema))
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items with a text, in blocks of at most ``block`` words (one item at least)."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct().orderBy("item_id", "text")
    held, size = [], 0
    for item, body in rows.toLocalIterator():
        n = len(words_of(bytes(body)))
        if not n:
            continue
        if held and size + n > block:
            yield held
            held, size = [], 0
        held.append((item, bytes(body)))
        size += n
    if held:
        yield held


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no copy of a test item; of rows that share an id, null ids too, each is judged by itself."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("text")))
    # rows of one name have one text, so one of them stands for all
    texts = inner.select(F.col("k1").alias("doc_id"), "k2", F.col("row.text").alias("text"))
    found = materialize(contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("doc_id", "k2")))
    return inner.join(found.select(F.col("doc_id").alias("k1"), "k2").distinct(), ["k1", "k2"], "left_anti").select("row.*")

"""Suffix-array dedup: remove every byte covered by a 200-byte string that also starts somewhere else.

Method: prefix doubling over the suffixes that are still shared. The positions are the minimisers of all 200-byte strings,
so that each string is known by a position in it and by how many bytes before the position it starts. Round by round:

* a position's text is ranked over a growing range around it, as a pair: the rank of the bytes that end at it and of the
  bytes that start at it. The range that all strings in question share begins with the ``PREFIX`` bytes of the
  minimiser and grows to 160, 190, 198 and 200 bytes, while the starts in question become fewer by ``1 / 2 ** STEP``;
* Spark sorts the position rank pairs by aggregation, positions with equal pairs get one new rank;
* a rank of only one position is unique, and its strings leave as not repeated; a position whose range has gone past the
  threshold for all of its strings and is still shared leaves as repeated; the others go on.

Ranks are names of the text (equal where the text is equal), so that a rank at a growing offset is not looked up by a join
but named from the text. Doubling from every byte position would sort as many rows as the corpus has bytes, each at least
16 bytes long; see the README for what was measured.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, row_key
from .minimisers import Units, covered, find_runs, keyed, list_arrays, unpack, with_lists

#: Bytes: the threshold, and the prefix that positions are first ranked by. Each round parts the starts in ``2 ** STEP``.
WIDTH, PREFIX, STEP = 200, 40, 2
_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def _bytes(body: bytes) -> Units:
    raw = np.frombuffer(body, np.uint8)
    return Units(body, len(raw), lambda a, b: _CODES[raw[a:b]])


def offsets(width: int = WIDTH, prefix: int = PREFIX, step: int = STEP) -> list[int]:
    """Binary places by which the starts are grouped in each round; the last is 0, every start on its own."""
    places = (width - prefix).bit_length()
    return [max(0, places - step * i) for i in range(1, -(-places // step) + 1)]


_STRINGS = "core long, span long, k1 long, k2 long, n long, lo int, mid int, least int, most int, text binary"
_NODES = "core long, span long, n long, open boolean, block int, first int, last int, common long, left long, right long, check long"


def _cut_strings(width: int):
    """The texts of the given runs: from the first byte of their first window to the last byte of their last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                core, span, n, lo, hi, mid = list_arrays(batch.column(3)[i], ("core", "span", "n", "lo", "hi", "mid"))
                body = unpack(batch.column(2)[i].as_py())
                text = [body[a : b + width] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                same = [pa.array(np.full(len(lo), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                cols = [pa.array(core), pa.array(span), *same, pa.array(n), *(pa.array(x.astype(np.int32)) for x in (lo, mid, mid - hi, mid - lo)), pa.array(text, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["core", "span", "k1", "k2", "n", "lo", "mid", "least", "most", "text"])

    return work


def ranges_of(text: bytes, mid: int, least: int, most: int, block: int, places: int, width: int, prefix: int) -> tuple[int, int, bytes, bytes, bytes]:
    """Of the strings that start ``block * 2 ** places`` to the next block's bytes before the position ``mid``: those that
    this text has (between ``least`` and ``most``), the bytes that all strings of the block share, and the bytes that these
    strings cover, up to the end of the prefix and from the position on."""
    a, b = block << places, ((block + 1) << places) - 1
    first, last = max(a, least), min(b, most)
    rest = width - prefix
    common = text[mid - a : mid + prefix + max(0, rest - b)]
    return first, last, common, text[mid - last : mid + prefix], text[mid : mid + prefix + rest - first]


def _rank(places: int, finer: int, width: int, prefix: int):
    """The blocks of each string's starts, each parted in ``2 ** finer``, with the rank pair of their range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_64_intdigest
        for batch in batches:
            own, state, out, ranks = [], [], [], []
            texts = batch.column(5)
            mid, least, most = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in (2, 3, 4))
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                blocks, n, is_open = (x.tolist() for x in list_arrays(batch.column(6)[i], ("block", "n", "open")))
                for k in range(len(blocks) << finer):
                    block, of = (blocks[k >> finer] << finer) + (k & ((1 << finer) - 1)), k >> finer
                    if block << places > most[i] or ((block + 1) << places) - 1 < least[i]:
                        continue
                    first, last, common, left, right = ranges_of(text, mid[i], least[i], most[i], block, places, width, prefix)
                    own.append(i)
                    state.append((n[of], is_open[of]))
                    out.append((block, first, last))
                    ranks.append((name(common, 4), name(left, 5), name(right, 6), name(left + right, 7)))
            take = pa.array(np.array(own, np.int64))
            where, rank = np.array(out, np.int32).reshape(-1, 3), np.array(ranks, np.uint64).reshape(-1, 4).view(np.int64)
            held = [pa.array([x[0] for x in state], pa.int64()), pa.array([x[1] for x in state], pa.bool_())]
            cols = [batch.column(0).take(take), batch.column(1).take(take), *held, *(pa.array(where[:, c].copy()) for c in range(3)), *(pa.array(rank[:, c].copy()) for c in range(4))]
            yield pa.RecordBatch.from_arrays(cols, names=["core", "span", "n", "open", "block", "first", "last", "common", "left", "right", "check"])

    return work


_PAIR = ["core", "first", "last", "left", "right", "check"]


def doubling(strings: DataFrame, width: int = WIDTH, prefix: int = PREFIX, step: int = STEP) -> tuple[DataFrame, list[int]]:
    """``(k1, k2, lo, hi)``: the repeated windows of the ``strings`` with ``n = 1``, and how many ranks each round sorted.

    ``strings(core, span, k1, k2, n, lo, mid, least, most, text)``: distinct texts around a minimiser at byte ``mid`` of
    their document, ``n`` of each; ``lo`` is the text's first byte, and its strings start ``least`` to ``most`` bytes
    before ``mid``. Every aggregation is partial and every join is of two written tables, so a rank that many positions
    share is not one task's work.
    """
    found, sizes, before = [], [], []
    whole = F.struct(F.lit(0).alias("block"), "n", (F.col("n") == 1).alias("open"))
    todo, last_places = strings.select("core", "span", F.array(whole).alias("blocks")), (width - prefix).bit_length()
    for places in offsets(width, prefix, step):
        named = strings.select("core", "span", (F.col("mid") - F.col("lo")).alias("at"), "least", "most", "text").join(todo, ["core", "span"])
        ranked = materialize(named.mapInArrow(_rank(places, last_places - places, width, prefix), _NODES))
        drop(*before)
        sizes.append(ranked.count())
        # positions with the same rank pair get one rank, whose bearer goes on for all of them
        pairs = ranked.groupBy(*_PAIR, "block", "common").agg(F.sum("n").alias("n"), F.min("span").alias("span"), F.max("open").alias("some_open"))
        pairs = materialize(pairs)
        past = ranked.where("open").join(pairs.where("some_open and n > 1").select(*_PAIR), _PAIR)
        found.append(materialize(past.select("core", "span", "first", "last")))
        pairs = pairs.withColumn("open", F.col("some_open") & (F.col("n") == 1))
        alive = pairs.groupBy("core", "block", "common").agg(F.sum("n").alias("total"), F.max("open").alias("some")).where("total > 1 and some")
        left = pairs.join(alive.select("core", "block", "common"), ["core", "block", "common"])
        before, last_places = [ranked, pairs], places
        if places:  # with every start on its own, the shared ranks are past the threshold and the others unique
            todo = materialize(left.groupBy("core", "span").agg(F.collect_list(F.struct("block", "n", "open")).alias("blocks")))
            before.append(todo)
    drop(*before)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    named = strings.where("n = 1").select("core", "span", "k1", "k2", "mid")
    return out.join(named, ["core", "span"]).select("k1", "k2", (F.col("mid") - F.col("last")).alias("lo"), (F.col("mid") - F.col("first")).alias("hi")), sizes


def repeated_ranges(docs: DataFrame, width: int = WIDTH, prefix: int = PREFIX, step: int = STEP) -> DataFrame:
    """``(k1, k2, lo, hi)``: the repeated windows ``lo..hi`` of ``docs`` (as ``keyed`` returns it), which can touch or overlap.

    Positions whose first ``prefix`` bytes are unique leave at once; a text around a position (its span) that occurs more
    than once is past the threshold as a whole; the other spans, each distinct one once, go through :func:`doubling`.
    """
    found = materialize(find_runs(docs, _bytes, width, prefix))
    shared = materialize(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    kept = materialize(found.join(shared, "core"))
    drop(found, shared)
    spans = kept.groupBy("core", "span").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "lo", "hi", "mid")))
    spans = materialize(spans)
    cores = materialize(spans.groupBy("core").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("least = 1 and spans > 1").select("core"))
    contested = spans.join(cores, "core").select("k1", "k2", "core", "span", "n", "lo", "hi", "mid")
    cut = with_lists(docs, contested, "runs", "inner").select("k1", "k2", "body", "runs")
    strings = materialize(cut.mapInArrow(_cut_strings(width), _STRINGS))
    whole = materialize(kept.join(spans.where("n > 1").select("core", "span"), ["core", "span"]).select("k1", "k2", "lo", "hi"))
    drop(kept, spans, cores)
    single, _ = doubling(strings, width, prefix, step)
    return whole.unionByName(single)


def rest_of(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(body[at:a])
        at = b
    return b"".join([*parts, body[at:]])


def whole_characters(body: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends, so that what is left is valid UTF-8."""
    out = []
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


_OUT = "doc_id long, k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def _report(width: int, texts: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                body = unpack(batch.column(3)[i].as_py())
                lo, hi = list_arrays(batch.column(4)[i], ("lo", "hi"))
                spans = covered(lo, hi, width, len(body))
                n = sum(b - a for a, b in spans)
                kept = rest_of(body, whole_characters(body, spans)) if texts else None
                rows.append((len(body), n, len(spans), hashlib.sha256(rest_of(body, spans)).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *made], names=["doc_id", "k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return work


def suffix_dedup(docs: DataFrame, width: int = WIDTH, prefix: int = PREFIX, step: int = STEP, texts: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: the removed byte spans and, with ``texts``, what is left.

    A byte goes if a ``width``-byte string over it starts at another place too, in any document or the same one.
    Every occurrence goes, the first too; strings are judged on the input. A null text counts as empty; a text shorter
    than ``width`` bytes is never touched; rows with the same id, null ids and equal texts are separate documents.
    ``kept_sha256`` is over the exact rest, which can end inside a character; ``kept`` keeps such characters whole.
    Other columns are not looked at; an empty table gives an empty result. ``k1, k2`` name the row (see ``row_key``).
    """
    body = keyed(docs)
    ranges = repeated_ranges(body, width, prefix, step)
    return with_lists(body, ranges, "ranges").select("doc_id", "k1", "k2", "body", "ranges").mapInArrow(_report(width, texts), _OUT)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage_suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with repeated 200-byte strings cut out of ``text``; a null text stays null. All rows and columns stay."""
    left = suffix_dedup(docs).where("n_removed > 0").select("k1", "k2", F.col("kept").cast("string").alias("kept")).dropDuplicates(["k1", "k2"])
    inner = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col("doc_id").cast("long"), F.col("text")))
    joined = inner.join(left, ["k1", "k2"], "left")
    text = F.coalesce("kept", F.col("row.text"))
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))

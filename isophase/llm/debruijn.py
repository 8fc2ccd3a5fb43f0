"""Substring dedup on words: remove words inside a 50-word window that also starts in a document with a smaller id.

Method: the de Bruijn graph whose edges are the token 50-mers; an edge goes from the node of its first 49 words to the node
of its last 49, and the two nodes' names together name it (128 bits).

1. Edges that meet in no other document leave first: consecutive 50-mers with the same minimiser are one row, and a
   minimiser that is in one document only has no repeated edge. Equal rows are one path with the coordinates of its first
   source: document, place. Paths whose minimiser has another path in an earlier document are taken apart into edges.
2. Equal edges are one edge, with the coordinates of its first source too. Edges of a single document leave.
3. In- and out-degrees are counted per node; edges that follow one another in their source through a node of degree one and
   one are joined into nonbranching paths (unitigs), cut every ``BLOCK`` places so that no task holds a whole document.
4. The edges of a text become pieces of unitigs, and these the spans of each document with their source coordinates. The
   words of every span are compared with the words at its source by a name of the whole text of both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialize
from .minimisers import MULTIPLIERS, Units, covered, find_runs, keyed, list_arrays, rolling, unpack, with_lists

#: Words: length of an edge, and of the minimisers; places of a source document in which a path is joined.
WIDTH, MINIMISER, BLOCK = 50, 10, 4096


class _Codes(dict):
    """64-bit code of a word; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word, 7)
        if len(self) < 200_000:
            self[word] = code
        return code


_codes = _Codes()


def words_of(body: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` cuts at just these six characters."""
    return body.split()


def _words(body: bytes) -> Units:
    words = words_of(body)
    n = len(words)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    return Units(b" ".join(words), n, lambda a, b: codes[a:b], end - size, end)


_EDGES = "core long, span long, place long, s1 long, s2 long, lo int, at int, from_node long, to_node long"


def _cut_edges(width: int):
    """The edges of the given runs, each with the names of the nodes that it joins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                core, span, place, lo, hi = list_arrays(batch.column(3)[i], ("core", "span", "place", "lo", "hi"))
                u = _words(unpack(batch.column(2)[i].as_py()))
                tails, heads = [], []
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    codes = u.codes(a, b + width)
                    tails.append(rolling(codes[:-1], width - 1, MULTIPLIERS[0]))
                    heads.append(rolling(codes[1:], width - 1, MULTIPLIERS[1]))
                n = hi - lo + 1
                run = np.repeat(np.arange(len(lo)), n)
                at = (np.arange(len(run)) - (np.cumsum(n) - n)[run] + lo[run]).astype(np.int32)
                same = [pa.array(np.full(len(run), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                cols = [pa.array(core[run]), pa.array(span[run]), pa.array(place[run]), *same, pa.array(lo[run]), pa.array(at), pa.array(np.concatenate(tails).view(np.int64)), pa.array(np.concatenate(heads).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["core", "span", "place", "s1", "s2", "lo", "at", "from_node", "to_node"])

    return work


def graph(edges: DataFrame) -> DataFrame:
    """``(from_node, to_node, place, s1, s2, at)``: each edge that several documents have, with its first source."""
    first = F.min(F.struct("place", "s1", "s2", "at")).alias("first")
    seen = edges.groupBy("from_node", "to_node").agg(first, F.max("place").alias("last"))
    return seen.where("first.place < last").select("from_node", "to_node", "first.*")


def unitigs(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``distinct`` (as :func:`graph` returns it) with ``path``, the place where the edge's nonbranching path begins.

    ``to_node`` names a node by another multiplier than ``from_node``, so a node is known by the edges on both its sides:
    an edge follows another where it comes next in the same source; the node between them does not branch if the one is
    the only edge out of it and the other the only edge into it. Edges are joined with these degrees.
    """
    out = materialize(distinct.groupBy("from_node").agg(F.count("*").alias("out")).where("out = 1").select("from_node"))
    into = materialize(distinct.groupBy("to_node").agg(F.count("*").alias("into")).where("into = 1").select("to_node"))
    marked = distinct.join(out.withColumn("one_out", F.lit(True)), "from_node", "left").join(into.withColumn("one_in", F.lit(True)), "to_node", "left")
    by = Window.partitionBy("s1", "s2", F.floor(F.col("at") / block)).orderBy("at")
    follows = (F.lag("at").over(by) == F.col("at") - 1) & F.col("one_out") & F.lag("one_in").over(by)
    start = F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("at"))
    path = F.last(start, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = materialize(marked.withColumn("path", path).drop("one_out", "one_in"))
    drop(out, into)
    return placed


def repeated_spans(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER, block: int = BLOCK) -> DataFrame:
    """``(k1, k2, lo, hi, s1, s2, at)``: windows ``lo..hi`` of ``docs`` (as ``keyed`` returns it) that start in a document
    with a smaller id too, in ``s1, s2`` from window ``at`` on. Spans of a document can touch or overlap."""
    found = materialize(find_runs(docs, _words, width, minimiser))
    shared = found.groupBy("core").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a < b")
    shared = materialize(shared.select("core"))
    kept = materialize(found.join(shared, "core").select("k1", "k2", "place", "core", "span", "lo", "hi"))
    drop(found, shared)
    first = F.min(F.struct("place", "k1", "k2", "lo", "hi")).alias("first")
    spans = materialize(kept.groupBy("core", "span").agg(first).select("core", "span", "first.*"))
    cores = spans.groupBy("core").agg(F.min("place").alias("a"), F.max("place").alias("b")).select("core", (F.col("a") < F.col("b")).alias("contested"))
    cores = materialize(cores.where("contested").select("core"))
    source = (F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("lo").alias("at"))
    paths = spans.select("core", "span", "place", F.lit(0).alias("begin"), (F.col("hi") - F.col("lo")).alias("end"), *source)
    cut = with_lists(docs, spans.join(cores, "core").select("k1", "k2", "core", "span", "place", "lo", "hi"), "runs", "inner")
    edges = materialize(cut.select("k1", "k2", "body", "runs").mapInArrow(_cut_edges(width), _EDGES))
    drop(cores)
    distinct = materialize(graph(edges))
    placed = unitigs(distinct, block)
    own = edges.select("core", "span", "from_node", "to_node", F.col("place").alias("own_place"), (F.col("at") - F.col("lo")).alias("nth"))
    met = own.join(placed, ["from_node", "to_node"]).where("place < own_place")
    # the edges of a text that lie on one path, one after another, are one piece of it
    pieces = met.groupBy("core", "span", "place", "s1", "s2", "path", (F.col("at") - F.col("nth")).alias("shift")).agg(F.min("nth").alias("begin"), F.max("nth").alias("end"))
    pieces = materialize(pieces.select("core", "span", "place", "begin", "end", "s1", "s2", (F.col("shift") + F.col("begin")).alias("at")))
    drop(edges, distinct, placed)
    earlier = materialize(paths.unionByName(pieces)).withColumnRenamed("place", "source_place")
    got = kept.join(earlier, ["core", "span"]).where("source_place < place")
    spans_of = got.select("k1", "k2", (F.col("lo") + F.col("begin")).alias("lo"), (F.col("lo") + F.col("end")).alias("hi"), "s1", "s2", "at")
    out = materialize(_joined(spans_of))
    drop(kept, spans, pieces, earlier)
    return out


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a document that go on in the same source at the same distance as one; only spans of one pair and distance meet."""
    by = Window.partitionBy("k1", "k2", "s1", "s2", F.col("at") - F.col("lo")).orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(0))
    parts = spans.withColumn("new", new).withColumn("part", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.withColumn("shift", F.col("at") - F.col("lo"))
    out = parts.groupBy("k1", "k2", "s1", "s2", "shift", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select("k1", "k2", "lo", "hi", "s1", "s2", (F.col("lo") + F.col("shift")).cast("int").alias("at"))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NAMES = "k1 long, k2 long, at int, n int, name_a long, name_b long"
_OUT = "doc_id long, k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept string"


def _name_texts(width: int):
    """128-bit names of the given word ranges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u = _words(unpack(batch.column(2)[i].as_py()))
                at, n = list_arrays(batch.column(3)[i], ("at", "n"))
                got = [xxhash.xxh3_128_intdigest(u.text(a, a + b + width - 1)) for a, b in zip(at.tolist(), n.tolist(), strict=True)]
                name = np.array([(x >> 64, x & ((1 << 64) - 1)) for x in got], np.uint64).reshape(-1, 2).view(np.int64)
                same = [pa.array(np.full(len(got), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at), pa.array(n), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())], names=["k1", "k2", "at", "n", "name_a", "name_b"])

    return work


def verified(docs: DataFrame, spans: DataFrame, width: int = WIDTH) -> DataFrame:
    """``spans`` (as :func:`repeated_spans` returns it) whose words are those at their source, compared by the names of
    both whole texts; only spans that two node names of different words had brought together would be left out."""
    size = (F.col("hi") - F.col("lo") + 1).alias("n")
    own = spans.select("k1", "k2", F.col("lo").alias("at"), size)
    sources = spans.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), "at", size)
    asked = with_lists(docs, own.union(sources).distinct(), "asked", "inner").select("k1", "k2", "body", "asked")
    named = materialize(asked.mapInArrow(_name_texts(width), _NAMES).distinct())
    here = named.select("k1", "k2", F.col("at").alias("lo"), "n", F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    there = named.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "at", "n", "name_a", "name_b")
    both = spans.withColumn("n", size).join(here, ["k1", "k2", "lo", "n"])
    same = materialize(both.join(there, ["s1", "s2", "at", "n"]).where("a = name_a and b = name_b").select("k1", "k2", "lo", "hi"))
    drop(named)
    return same


def _report(width: int, texts: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words = words_of(unpack(batch.column(3)[i].as_py()))
                lo, hi = list_arrays(batch.column(4)[i], ("lo", "hi"))
                spans, at, left = covered(lo, hi, width, len(words)), 0, []
                for a, b in spans:
                    left += words[at:a]
                    at = b
                kept = b" ".join(left + words[at:] if spans else words)
                n = sum(b - a for a, b in spans)
                rows.append((len(words), n, hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept.decode(errors="replace") if texts else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *made], names=["doc_id", "k1", "k2", "n_words", "n_removed", "kept_sha256", "spans", "kept"])

    return work


def substring_dedup(docs: DataFrame, width: int = WIDTH, minimiser: int = MINIMISER, texts: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: removed word spans and, with ``texts``, the kept words.

    A word goes if a window of ``width`` words over it has the same words as a window of a document with a smaller id;
    windows are judged on the input. The first copy stays, and repeats inside one document stay. Rows with the same id
    do not remove each other's words; a null id counts as larger than all others. A null text has no words; a text of
    fewer than ``width`` words is never touched. Other columns are not looked at; an empty table gives an empty result.
    """
    body = keyed(docs)
    ranges = verified(body, repeated_spans(body, width, minimiser, block), width)
    return with_lists(body, ranges, "ranges").select("doc_id", "k1", "k2", "body", "ranges").mapInArrow(_report(width, texts), _OUT)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")

"""Windows of whole texts grouped by their minimiser, which the byte-level and the word-level operator start from.

A window is ``width`` consecutive units (bytes or words) of one document. Naming every window would shuffle many times
the corpus, so consecutive windows whose smallest ``k``-unit hash is at the same place (their minimiser) form a *run*.
Equal windows have equal minimisers at equal offsets: a run whose minimiser (its *core*) occurs nowhere else has only
windows that occur nowhere else, and the whole text of a run (its *span*) stands for all of its windows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key

CHUNK = 1 << 16
LAST = (1 << 63) - 1
_MASK = np.uint64((1 << 20) - 1)
#: Odd multipliers of the two rolling names.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if (p, n) not in _POWERS:
        up, down = np.full(n, p, np.uint64), np.full(n, pow(p, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[p, n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[p, n]


def rolling(codes: np.ndarray, k: int, p: int = MULTIPLIERS[0]) -> np.ndarray:
    """64-bit names of all ``k``-unit strings of at most ``CHUNK`` + some hundred units, from the units' codes."""
    if len(codes) < k:
        return np.empty(0, np.uint64)
    up, down = _powers(p, 1 << max(10, len(codes).bit_length()))
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    name = total[k:] - total[:-k]
    name *= down[: len(name)]
    name ^= name >> np.uint64(32)
    name *= np.uint64(0xD6E8FEB86659FD93)
    name ^= name >> np.uint64(29)
    return name


@dataclass(frozen=True)
class Units:
    """A text of ``n`` units: unit i is ``body[start[i]:end[i]]``, or byte i where these are None; ``codes(a, b)``: 64-bit codes of units a..b-1."""

    body: bytes
    n: int
    codes: Callable[[int, int], np.ndarray]
    start: np.ndarray | None = None
    end: np.ndarray | None = None

    def text(self, a: int, b: int) -> bytes:
        """Units a..b-1 as bytes."""
        return self.body[a:b] if self.start is None else self.body[self.start[a] : self.end[b - 1]]


def runs(u: Units, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser position of each run.

    Works through the text in chunks, so arrays do not grow with a document; a run is cut where a chunk ends.
    """
    windows, w = u.n - width + 1, width - k + 1
    if windows <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, windows, CHUNK):
        n = min(CHUNK, windows - at)
        name = rolling(u.codes(at, at + n + width - 1), k)
        size = -(-len(name) // w) * w
        key = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        key[: len(name)] = (name & ~_MASK) | np.arange(len(name), dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _MASK).astype(np.int64)
        cut = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [n])) - 1
        out.append((first + at, last + at, place[first] + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def names(u: Units, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit names of the unit ranges [first, end)."""
    if not len(first):
        return np.empty(0, np.int64)
    digest, body = xxhash.xxh3_64_intdigest, u.body
    a, b = (first.tolist(), end.tolist()) if u.start is None else (u.start[first].tolist(), u.end[end - 1].tolist())
    return np.fromiter((digest(body[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a)).view(np.int64)


_FOUND = "k1 long, k2 long, place long, core long, span long, lo int, hi int, mid int"


def _find(cut: Callable[[bytes], Units], width: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], []
            for i, text in enumerate(batch.column(3)):
                u = cut(text.as_py() or b"")
                lo, hi, m = runs(u, width, k)
                if len(lo):
                    rows.append(np.full(len(lo), i))
                    cols.append((names(u, m, m + k, 1), names(u, lo, hi + width, 2), lo.astype(np.int32), hi.astype(np.int32), m.astype(np.int32)))
            if rows:
                take = pa.array(np.concatenate(rows))
                parts = [pa.array(np.concatenate(x)) for x in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), *parts], names=["k1", "k2", "place", "core", "span", "lo", "hi", "mid"])

    return work


def find_runs(docs: DataFrame, cut: Callable[[bytes], Units], width: int, k: int) -> DataFrame:
    """``(k1, k2, place, core, span, lo, hi, mid)``: the runs of ``docs`` (as :func:`keyed` returns it); ``place`` is the
    ``doc_id``, null as ``LAST``; ``mid`` where the minimiser starts. Names are 64 bits, compared as pairs (core, span)."""
    return docs.select("k1", "k2", F.coalesce("doc_id", F.lit(LAST)).alias("place"), "body").mapInArrow(_find(cut, width, k), _FOUND)


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, body``: the text as bytes, with the 128-bit name of the row."""
    doc, text = F.col("doc_id").cast("long"), F.col("text")
    return docs.select(doc.alias("doc_id"), *row_key(doc, text), text.cast("binary").alias("body"))


def unpack(body: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body) if body else b""


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        body = pa.array([squeeze.compress(t.as_py() or b"") for t in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), body], names=["doc_id", "k1", "k2", "body"])


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (as :func:`keyed` returns it) with compressed bodies, for :func:`unpack`."""
    return docs.mapInArrow(_pack, "doc_id long, k1 long, k2 long, body binary")


def with_lists(docs: DataFrame, rows: DataFrame, name: str, how: str = "left") -> DataFrame:
    """Each row of ``docs``, packed, with the array ``name`` of its ``rows(k1, k2, ...)`` (left join: null if it has none)."""
    inner = F.struct(*(c for c in rows.columns if c not in ("k1", "k2")))
    return packed(docs).join(rows.groupBy("k1", "k2").agg(F.collect_list(inner).alias(name)), ["k1", "k2"], how)


def list_arrays(value: pa.ListScalar, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The fields of a list of structs as numpy arrays, without a Python object for each entry."""
    if not value.is_valid:
        return tuple(np.empty(0, np.int64) for _ in fields)
    return tuple(value.values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def covered(lo: np.ndarray, hi: np.ndarray, width: int, units: int) -> list[tuple[int, int]]:
    """Maximal runs ``[a, b)`` of units that the windows ``lo..hi`` cover, sorted."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    a, b = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + width)
    new = np.concatenate(([True], a[1:] > b[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(a)])) - 1
    return list(zip(a[first].tolist(), np.minimum(b[last], units).tolist(), strict=True))

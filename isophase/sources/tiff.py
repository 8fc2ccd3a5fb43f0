"""Single-band TIFF rasters: a baseline reader, a writer, and both as Spark jobs with one task per file."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: tags, and field types as struct codes.
_WIDTH, _HEIGHT, _BITS, _PACKING, _PHOTOMETRIC, _STRIPS, _SAMPLES, _ROWS, _COUNTS, _PREDICTOR, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
_TILES = 322
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_UNSIGNED, _SIGNED, _FLOAT = 1, 2, 3


def decode(raw: bytes) -> np.ndarray:
    """The raster of a striped single-band TIFF or BigTIFF, uncompressed or deflated; integers and floats of any size."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(f"{order}H", raw[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{order}Q", raw, 8)[0] if big else struct.unpack_from(f"{order}I", raw, 4)[0]
    n = struct.unpack_from(f"{order}Q" if big else f"{order}H", raw, at)[0]
    at += 8 if big else 2
    tags: dict[int, tuple] = {}
    for k in range(n):
        entry = at + k * (20 if big else 12)
        tag, kind = struct.unpack_from(f"{order}HH", raw, entry)
        count = struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, entry + 4)[0]
        if kind not in _TYPES:
            continue
        code, value = f"{order}{count}{_TYPES[kind]}", entry + (12 if big else 8)
        if struct.calcsize(code) > (8 if big else 4):
            value = struct.unpack_from(f"{order}Q" if big else f"{order}I", raw, value)[0]
        tags[tag] = struct.unpack_from(code, raw, value)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(_SAMPLES, 1) != 1 or _TILES in tags or one(_PREDICTOR, 1) != 1:
        raise ValueError("only striped single-band files without a predictor are read")
    kind = {_UNSIGNED: "u", _SIGNED: "i", _FLOAT: "f"}.get(one(_FORMAT, _UNSIGNED))
    packing, width, height = one(_PACKING, 1), one(_WIDTH, 0), one(_HEIGHT, 0)
    if kind is None or packing not in (1, 8, 32946) or one(_BITS, 1) % 8:
        raise ValueError("sample format or compression is not supported")
    parts = [raw[a : a + c] for a, c in zip(tags[_STRIPS], tags[_COUNTS], strict=True)]
    body = b"".join(parts if packing == 1 else map(zlib.decompress, parts))
    cells = np.frombuffer(body, f"{order}{kind}{one(_BITS, 1) // 8}", width * height)
    return cells.reshape(height, width).astype(cells.dtype.newbyteorder("="))


def read_floats(raw: bytes) -> np.ndarray:
    grid = decode(raw)
    if grid.dtype.kind != "f":
        raise ValueError("not a float raster")
    return grid.astype(np.float32)


def read_mask(raw: bytes) -> np.ndarray:
    """Valid where the sample is finite and not zero."""
    grid = decode(raw)
    return np.isfinite(grid) & (grid != 0)


def encode(grid: np.ndarray, rows_per_strip: int = 256) -> bytes:
    """An uncompressed little-endian TIFF; BigTIFF where 32-bit offsets would not do."""
    kind = {"u": _UNSIGNED, "i": _SIGNED, "f": _FLOAT}[grid.dtype.kind]
    grid = np.ascontiguousarray(grid, grid.dtype.newbyteorder("<"))
    height, width = grid.shape
    big = grid.nbytes > 0xF000_0000
    strips = [grid[a : a + rows_per_strip].tobytes() for a in range(0, height, rows_per_strip)]
    counts = [len(s) for s in strips]
    word, kind_word, head = ("Q", 16, 16) if big else ("I", 4, 8)
    starts = np.cumsum([head, *counts])[:-1].tolist()
    fields = [(_WIDTH, 4, [width]), (_HEIGHT, 4, [height]), (_BITS, 3, [grid.dtype.itemsize * 8]), (_PACKING, 3, [1]), (_PHOTOMETRIC, 3, [1]), (_STRIPS, kind_word, starts), (_SAMPLES, 3, [1]), (_ROWS, 4, [rows_per_strip]), (_COUNTS, kind_word, counts), (_FORMAT, 3, [kind])]
    pad = b"\0" * (-(head + sum(counts)) % 8)
    first = head + sum(counts) + len(pad)
    entries, extra = [], b""
    room, beyond = (8, first + 8 + 20 * len(fields) + 8) if big else (4, first + 2 + 12 * len(fields) + 4)
    for tag, code, values in fields:
        body = struct.pack(f"<{len(values)}{_TYPES[code]}", *values)
        if len(body) > room:
            body, extra = struct.pack(f"<{word}", beyond + len(extra)), extra + body
        entries.append(struct.pack(f"<HH{word}", tag, code, len(values)) + body.ljust(room, b"\0"))
    top = struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first)
    return b"".join([top, *strips, pad, struct.pack("<Q" if big else "<H", len(fields)), *entries, struct.pack(f"<{word}", 0), extra])


def encode_labels(labels: np.ndarray) -> bytes:
    if labels.max(initial=0) > 65535:
        raise ValueError("more than 65535 labels")
    return encode(labels.astype(np.uint16))


def tiff_pixels(spark: SparkSession, path: str, mask: bool = False) -> DataFrame:
    """``(frame_id, i, j, v)`` of all files under ``path``, ``v`` a float or, with ``mask``, a boolean."""

    def rows(frames):
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                grid = read_mask(raw) if mask else read_floats(raw)
                for a in range(0, len(grid), 256):
                    i, j = np.indices(grid[a : a + 256].shape)
                    yield pd.DataFrame({"frame_id": Path(name).stem, "i": (i.ravel() + a).astype("int32"), "j": j.ravel().astype("int32"), "v": grid[a : a + 256].ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"frame_id string, i int, j int, v {'boolean' if mask else 'float'}")


def write_tiffs(pixels: DataFrame, folder: str, labels: bool = False) -> DataFrame:
    """Write each frame of ``pixels(frame_id, i, j, v)`` to ``folder/frame_id.tif``, one task per frame; missing pixels are
    NaN, or 0 for labels. ``folder`` must be one that all executors mount. Returns ``(frame_id, path, n_bytes)``, and
    writes when that is evaluated; a file appears under its name only when it is whole, so that tasks can be run again.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((int(pdf.i.max()) + 1, int(pdf.j.max()) + 1), 0 if labels else np.nan, np.int64 if labels else np.float32)
        grid[pdf.i.to_numpy(int), pdf.j.to_numpy(int)] = pdf.v.to_numpy()
        raw = encode_labels(grid) if labels else encode(grid)
        name = str(pdf.frame_id.iloc[0])
        path = os.path.join(folder, f"{name}.tif")
        part = f"{path}.{uuid.uuid4().hex}.part"
        Path(part).write_bytes(raw)
        os.replace(part, path)
        return pd.DataFrame({"frame_id": [name], "path": [path], "n_bytes": [len(raw)]})

    return pixels.select("frame_id", "i", "j", "v").groupBy("frame_id").applyInPandas(one, "frame_id string, path string, n_bytes long")

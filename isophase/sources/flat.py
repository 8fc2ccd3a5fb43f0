"""Flat binary rasters and their sidecars: rows of floats in several layouts, read by Spark's own file reader."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Meta:
    width: int | None = None
    rows: int | None = None
    big_endian: bool = False
    layout: str = "auto"


#: Keys of the parameter files; of several in a file, the first counts.
_WIDTH_KEYS = {"width", "range_samp", "range_samples", "interferogram_width"}
_ROWS_KEYS = {"nlines", "az_samp", "azimuth_lines", "interferogram_azimuth_lines"}


def parse_rsc(text: str) -> Meta:
    pairs = dict(line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)
    if "WIDTH" not in pairs:
        raise ValueError("WIDTH is missing")
    rows = pairs.get("FILE_LENGTH")
    return Meta(int(pairs["WIDTH"]), int(rows) if rows else None)


def parse_xml(text: str) -> Meta:
    def value(name: str) -> str | None:
        found = re.search(rf'name="{name}".*?<value>\s*(.*?)\s*</value>', text, re.S | re.I)
        return found[1] if found else None

    bands, scheme = value("number_bands"), (value("scheme") or "").lower()
    layout = "single" if bands in (None, "1") else {"bil": "altline", "bip": "altsample", "bsq": "bsq"}.get(scheme, "auto")
    width, rows = value("width"), value("length")
    return Meta(int(width) if width else None, int(rows) if rows else None, (value("byte_order") or "l").lower().startswith("b"), layout)


def parse_par(text: str) -> Meta:
    """A colon-keyed parameter file, which stands for big-endian rasters; without a width it is an error."""
    width = rows = None
    for line in text.splitlines():
        key, colon, rest = line.partition(":")
        value = rest.split()[0] if colon and rest.split() else None
        if value and key.strip() in _WIDTH_KEYS and width is None:
            width = int(value)
        elif value and key.strip() in _ROWS_KEYS and rows is None:
            rows = int(value)
    if width is None:
        raise ValueError("no key with the width")
    return Meta(width, rows, True)


def parse_sidecar(name: str, text: str) -> Meta:
    kind = Path(name).suffix.lower()
    return parse_rsc(text) if kind == ".rsc" else parse_xml(text) if kind == ".xml" else parse_par(text)


def resolve(flag: Meta, sidecar: Meta | None) -> Meta:
    """Given values before those of the sidecar; big-endian if either says so."""
    s = sidecar or Meta()
    return Meta(flag.width or s.width, flag.rows or s.rows, flag.big_endian or s.big_endian, flag.layout if flag.layout != "auto" else s.layout)


def read_floats(raw: bytes, meta: Meta, rows: int | None = None) -> np.ndarray:
    """A float32 raster; of two bands the second one. ``auto`` tells one band from two by the expected rows."""
    x = np.frombuffer(raw, ">f4" if meta.big_endian else "<f4").astype(np.float32)
    if not meta.width or len(x) % meta.width:
        raise ValueError("the size is not a whole number of rows")
    lines, layout = len(x) // meta.width, meta.layout
    expected = rows or meta.rows
    if layout == "auto":
        if expected in (None, lines):
            layout = "single"
        elif lines == 2 * expected:
            layout = "altline"
        else:
            raise ValueError(f"{lines} rows, expected {expected} or twice as many")
    grid = x.reshape(lines, meta.width)
    if layout == "single":
        return grid
    if layout == "altline":
        return grid[1::2]
    if layout == "altsample":
        return x.reshape(lines // 2, meta.width, 2)[:, :, 1]
    return grid[lines // 2 :]


def read_complex(raw: bytes, meta: Meta) -> np.ndarray:
    x = np.frombuffer(raw, ">c8" if meta.big_endian else "<c8").astype(np.complex64)
    if not meta.width or len(x) % meta.width:
        raise ValueError("the size is not a whole number of rows")
    return x.reshape(-1, meta.width)


def read_mask(raw: bytes, rows: int, cols: int, big_endian: bool = False) -> np.ndarray:
    """One byte a pixel, not zero being valid; or one float a pixel, finite and not zero being valid."""
    n = rows * cols
    if len(raw) == n:
        return (np.frombuffer(raw, np.uint8) != 0).reshape(rows, cols)
    if len(raw) == 4 * n:
        x = np.frombuffer(raw, ">f4" if big_endian else "<f4")
        return (np.isfinite(x) & (x != 0)).reshape(rows, cols)
    raise ValueError("the mask has another size")


def write_floats(unw: np.ndarray, big_endian: bool = False) -> bytes:
    return unw.astype(">f4" if big_endian else "<f4").tobytes()


def write_altline(amplitude: np.ndarray, unw: np.ndarray, big_endian: bool = False) -> bytes:
    return write_floats(np.stack([amplitude, unw], axis=1).reshape(-1, unw.shape[1]), big_endian)


def write_labels(labels: np.ndarray) -> bytes:
    if labels.max(initial=0) > 255:
        raise ValueError("more than 255 labels")
    return labels.astype(np.uint8).tobytes()


def flat_pixels(spark: SparkSession, path: str, meta: Meta, kind: str = "float") -> DataFrame:
    """``(frame_id, i, j, v)`` or, for ``complex``, ``(frame_id, i, j, re, im)`` of all rasters under ``path``.

    One task per file through ``binaryFile``; the frame is the file's name without its last suffix.
    """

    def rows(frames):
        for pdf in frames:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                grid = read_complex(raw, meta) if kind == "complex" else read_floats(raw, meta)
                for a in range(0, len(grid), 256):
                    part = grid[a : a + 256]
                    i, j = np.indices(part.shape)
                    out = {"frame_id": Path(name).stem, "i": (i.ravel() + a).astype("int32"), "j": j.ravel().astype("int32")}
                    out |= {"re": part.real.ravel(), "im": part.imag.ravel()} if kind == "complex" else {"v": part.ravel()}
                    yield pd.DataFrame(out)

    fields = "re float, im float" if kind == "complex" else "v float"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, f"frame_id string, i int, j int, {fields}")

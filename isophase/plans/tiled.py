"""Frames too large for one task: tiles are solved apart, their cycle offsets reconciled, and the tiles merged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isophase import api
from isophase.operators import frames as fr
from isophase.solver import mcf, network

TILES = "frame_id string, tile_r int, tile_c int, i int, j int, unw double, corr double, w double"


def solved_tiles(pixels: DataFrame, rows: int, cols: int, nlooks: float, tile: int, overlap: int, options: api.Options) -> DataFrame:
    """Each tile unwrapped by itself, one task per tile; ``w`` falls off towards the tile's rim."""
    shape, step = (min(tile, rows), min(tile, cols)), tile - overlap
    (n_rows, last_r), (n_cols, last_c) = fr.tile_ends(rows, tile, overlap), fr.tile_ends(cols, tile, overlap)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = int(pdf.tile_r.iloc[0]), int(pdf.tile_c.iloc[0])
        start_r, start_c = r * step if r < n_rows - 1 else last_r, c * step if c < n_cols - 1 else last_c
        phase, corr, mask = api._grid(pdf.assign(i=pdf.i - start_r, j=pdf.j - start_c), shape)
        unw, _ = api.unwrap_arrays(phase, corr, mask, nlooks, options)
        i, j = mask.nonzero()
        taper = lambda at, n: pd.Series(at + 1).clip(upper=pd.Series(n - at)).to_numpy(float)
        return pd.DataFrame({
            "frame_id": pdf.frame_id.iloc[0], "tile_r": r, "tile_c": c, "i": i + start_r, "j": j + start_c,
            "unw": unw[i, j], "corr": corr[i, j], "w": taper(i, shape[0]) * taper(j, shape[1]),
        })

    d = fr.decomposed(pixels.select("frame_id", "i", "j", "psi", "corr", "mask"), rows, cols, tile, overlap)
    keys = ("frame_id", "tile_r", "tile_c")
    return api.spread(d, *keys).groupBy(*keys).applyInPandas(one, TILES)


def seam_offsets(tiles: DataFrame, n_cols: int) -> DataFrame:
    """``(frame_id, ta, tb, k, confidence)`` of each tile and the one to its right or below, from the pixels of both."""
    parts = []
    for dr, dc in ((0, 1), (1, 0)):
        a, b = tiles.alias("a"), tiles.withColumn("tile_r", F.col("tile_r") - dr).withColumn("tile_c", F.col("tile_c") - dc).alias("b")
        pairs = a.join(b, ["frame_id", "tile_r", "tile_c", "i", "j"])
        ta = F.col("tile_r") * n_cols + F.col("tile_c")
        parts.append(pairs.select("frame_id", ta.alias("ta"), (ta + dr * n_cols + dc).alias("tb"), F.col("a.unw").alias("a"), F.col("b.unw").alias("b"), F.col("a.corr").alias("corr")))
    return fr.stitching_offsets(parts[0].unionByName(parts[1]), ["frame_id", "ta", "tb"])


def unwrap_tiled(pixels: DataFrame, rows: int, cols: int, nlooks: float, tile: int = 512, overlap: int = 64, options: api.Options = api.Options(bridge=False)) -> DataFrame:
    """``(frame_id, i, j, unw)`` of ``pixels(frame_id, i, j, psi, corr, mask)``, frames of ``rows`` by ``cols``.

    Masked pixels are left out. Only seams, a few numbers per tile that holds pixels, meet in one task per frame; stretches
    of rows without any are passed over, and what lies beyond them is some whole cycles off. Solved tiles are read
    three times and are checkpointed; without ``spark.checkpoint.dir`` they are kept on disk on a local master only.
    """
    if not 0 < overlap < tile:
        raise ValueError("overlap must be positive and less than the tile")
    n_cols = fr.tile_ends(cols, tile, overlap)[0]
    tiles = solved_tiles(pixels, rows, cols, nlooks, tile, overlap, options)
    shared = pixels.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared and not pixels.sparkSession.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    tiles = tiles.checkpoint() if shared else tiles.persist(StorageLevel.DISK_ONLY)

    def shifts(pdf: pd.DataFrame) -> pd.DataFrame:
        ta, tb = pdf.ta.to_numpy(), pdf.tb.to_numpy()
        held = np.unique(np.concatenate([ta, tb]) // n_cols)  # rows of tiles; between those not next to each other there is no seam
        place = lambda t: (np.searchsorted(held, t // n_cols) * n_cols + t % n_cols).tolist()
        seams = dict(zip(zip(place(ta), place(tb), strict=True), zip(pdf.k.tolist(), pdf.confidence.tolist(), strict=True), strict=True))
        off = network.reconcile(len(held), n_cols, seams)
        tile_of = held[:, None] * n_cols + np.arange(n_cols)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "tile": tile_of.ravel(), "shift": off.ravel()})

    shift = seam_offsets(tiles, n_cols).groupBy("frame_id").applyInPandas(shifts, "frame_id string, tile int, shift long")
    moved = tiles.withColumn("tile", F.col("tile_r") * n_cols + F.col("tile_c")).join(shift, ["frame_id", "tile"], "left")
    v = F.col("unw") - float(mcf.TAU) * F.coalesce("shift", F.lit(0))
    return fr.feathered(moved.select("frame_id", "i", "j", v.alias("v"), "w")).withColumnRenamed("v", "unw")

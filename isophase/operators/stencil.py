"""Neighbourhood operators on pixel rows ``(frame_id, i, j, ...)``.

Neighbours are found with windows over one row of a frame, or one column of a block of its rows, so every task holds at
most one line of pixels, and frames of any height are spread over tasks; a missing pixel row is a missing neighbour, never
the next one further on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isophase.functions.phase import cycle_difference, mask_digits, wrap


#: Rows of a frame in a block.
BLOCK = 256


def _row():
    return Window.partitionBy("frame_id", "i").orderBy("j")


def _column():
    return Window.partitionBy("frame_id", "_b", "j").orderBy("i")


def _blocked(pixels: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """``pixels`` with their block ``_b``, and copies (``_copy``) of the rows so far before and after each block."""
    size = max(BLOCK, 2 * (before + after))
    block = lambda i: F.floor(i / size).cast("int")
    p = pixels.withColumn("_b", F.explode(F.sequence(block(F.col("i") - after), block(F.col("i") + before))))
    return p.withColumn("_copy", F.col("_b") != block(F.col("i")))


def _unblocked(pixels: DataFrame) -> DataFrame:
    return pixels.where("not _copy").drop("_b", "_copy")


def per_frame(rows: DataFrame, table: DataFrame, key: str = "frame_id", parts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``table``, one row of each frame; frames without one are left out.

    A frame of any size is spread over ``parts`` keys, so a join that is not broadcast has no task for a whole frame.
    """
    t = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    r = rows.withColumn("_part", F.pmod(F.hash(*(c for c in rows.columns if c != key)), F.lit(parts)))
    return r.join(t, [key, "_part"]).drop("_part")


def right(value: str) -> Column:
    return F.when(F.lead("j").over(_row()) == F.col("j") + 1, F.lead(value).over(_row()))


def below(value: str) -> Column:
    return F.when(F.lead("i").over(_column()) == F.col("i") + 1, F.lead(value).over(_column()))


def residues(pixels: DataFrame) -> DataFrame:
    """Interior residues ``(frame_id, i, j, charge)`` of ``pixels(frame_id, i, j, psi, mask)``, zero ones left out.

    The loop runs counter-clockwise over (i,j), (i,j+1), (i+1,j+1), (i+1,j); it is skipped where a pixel is missing or
    masked. ``i, j`` is the node at the loop's centre, counted from 1.
    """
    p = pixels.withColumn("r", right("psi")).withColumn("rm", right("mask"))
    p = _blocked(p, after=1).withColumn("d", below("psi")).withColumn("dm", below("mask")).withColumn("x", below("r")).withColumn("xm", below("rm"))
    p = _unblocked(p).where("mask and rm and dm and xm")
    top, east = cycle_difference(F.col("psi"), F.col("r")), cycle_difference(F.col("r"), F.col("x"))
    bottom, west = cycle_difference(F.col("x"), F.col("d")), cycle_difference(F.col("d"), F.col("psi"))
    charge = top + east + bottom + west
    out = p.select("frame_id", (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), charge.alias("charge"))
    return out.where("charge <> 0")


def frame_deposits(pixels: DataFrame) -> DataFrame:
    """Residues on the frame of each image, which make the sum over all nodes zero where nothing is masked:
    ``(frame_id, side, at, charge)``. An edge with a masked end is skipped."""
    ends = pixels.groupBy("frame_id").agg(F.max("i").alias("last_i"), F.max("j").alias("last_j"))
    p = pixels.withColumn("rm", right("mask")).withColumn("r", F.when(F.col("mask") & F.col("rm"), right("psi")))
    p = _blocked(p, after=1).withColumn("dm", below("mask")).withColumn("d", F.when(F.col("mask") & F.col("dm"), below("psi")))
    p = per_frame(_unblocked(p), ends)
    along, down = cycle_difference(F.col("psi"), F.col("r")), cycle_difference(F.col("psi"), F.col("d"))
    side = lambda name, where, at, charge: p.where(where).select("frame_id", F.lit(name).alias("side"), (F.col(at) + 1).alias("at"), charge.alias("charge"))
    out = side("top", "i = 0 and r is not null", "j", -along).unionByName(side("bottom", "i = last_i and r is not null", "j", along))
    out = out.unionByName(side("left", "j = 0 and d is not null", "i", down)).unionByName(side("right", "j = last_j and d is not null", "i", -down))
    return out.where("charge <> 0")


def edges(pixels: DataFrame) -> DataFrame:
    """Pixel edges ``(frame_id, dir, i, j, gradient, corr, both, none)`` of ``pixels(..., psi, corr, mask)``.

    ``dir`` is h for (i,j)-(i,j+1) and v for (i,j)-(i+1,j); ``corr`` is the smaller coherence; ``both`` and ``none`` tell
    whether both or neither of the two pixels are valid.
    """
    def part(name: str, step) -> DataFrame:
        p = _blocked(pixels, after=1) if step is below else pixels
        p = p.withColumn("q", step("psi")).withColumn("qc", step("corr")).withColumn("qm", step("mask")).where("q is not null")
        p = _unblocked(p) if step is below else p
        return p.select("frame_id", F.lit(name).alias("dir"), "i", "j", wrap(F.col("q") - F.col("psi")).alias("gradient"), F.least("corr", "qc").alias("corr"), (F.col("mask") & F.col("qm")).alias("both"), (~F.col("mask") & ~F.col("qm")).alias("none"))

    return part("h", right).unionByName(part("v", below))


def box_filter(values: DataFrame, k_row: int, k_col: int, value: str = "v") -> DataFrame:
    """Mean over a ``k_row`` by ``k_col`` box with the nearest pixel beyond the edge, along rows and then columns.

    For an even width the box reaches one further ahead. Lines must be without gaps.
    """
    for k, line in ((k_col, ("frame_id", "i", "j")), (k_row, ("frame_id", "j", "i"))):
        lo, hi = (k - 1) // 2, k // 2
        part = Window.partitionBy(*line[:2]).orderBy(line[2])
        every = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = F.row_number().over(part)
        n = F.count("*").over(every)
        inside = F.sum(value).over(part.rowsBetween(-lo, hi))
        before = F.greatest(F.lit(lo) - (place - 1), F.lit(0)) * F.first(value).over(every)
        after = F.greatest(F.lit(hi) - (n - place), F.lit(0)) * F.last(value).over(every)
        values = values.withColumn(value, (inside + before + after) / k)
    return values


def masked_box_filter(values: DataFrame, k_row: int, k_col: int) -> DataFrame:
    """Mean of ``v`` over the valid pixels (``mask``) of the box; 0 where there is none."""
    x = values.withColumn("_w", F.col("mask").cast("double")).withColumn("v", F.when(F.col("mask"), F.col("v")).otherwise(0.0))
    x = box_filter(box_filter(x, k_row, k_col, "v"), k_row, k_col, "_w")
    return x.withColumn("v", F.when(F.col("_w") * (k_row * k_col) <= 1e-6, 0.0).otherwise(F.col("v") / F.col("_w"))).drop("_w")


def _nearest(of: Column, axis: str, *line: str) -> Column:
    """Least ``of + |distance along the line|`` over the pixels of a line, by a running minimum from either end.

    The way back is a window in falling order: one that ends at the last row is taken anew at each row, which is quadratic.
    """
    run = lambda order: Window.partitionBy(*line).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead, back = run(F.col(axis).asc()), run(F.col(axis).desc())
    return F.least(F.min(of - F.col(axis)).over(ahead) + F.col(axis), F.min(of + F.col(axis)).over(back) - F.col(axis))


def eroded(pixels: DataFrame, k: int) -> DataFrame:
    """``pixels`` whose ``mask`` is false within ``k`` steps of 4-neighbours of a false pixel; beyond the image is true.

    The distance in steps is found along the rows and then along the columns, and the other way round, so that a single
    missing pixel is no obstacle. Columns are cut into blocks of rows, which see the ``k`` rows on either side of them:
    distances beyond ``k`` are of no account. Rows are at most doubled, whatever ``k`` is.
    """
    row, column = ("j", "frame_id", "i"), ("i", "frame_id", "_b", "j")
    p = pixels.withColumn("_z", F.when(~F.col("mask"), F.lit(0))).withColumn("_r", _nearest(F.col("_z"), *row))
    p = _blocked(p, k, k).withColumn("_c", _nearest(F.col("_z"), *column)).withColumn("_rc", _nearest(F.col("_r"), *column))
    p = _unblocked(p).withColumn("_cr", _nearest(F.col("_c"), *row))
    far = F.coalesce(F.least("_rc", "_cr") > k, F.lit(True))
    return p.withColumn("mask", F.col("mask") & far).drop("_z", "_r", "_c", "_rc", "_cr")


def open_water_mask(pixels: DataFrame, erode_px: int = 25) -> DataFrame:
    """``pixels(frame_id, i, j, code, ...)`` with ``mask``: valid samples of both swaths that are not interior open water.

    Water more than ``erode_px`` steps from other pixels is left out; shores and narrow water stay.
    """
    water, ref, sec = mask_digits(F.col("code"))
    inner = eroded(pixels.withColumn("mask", water != 0), erode_px).withColumnRenamed("mask", "_inner")
    valid = (F.col("code").bitwiseAND(255) != 255) & (ref > 0) & (sec > 0)
    return inner.withColumn("mask", valid & ~F.col("_inner")).drop("_inner")


def center_crop(pixels: DataFrame, size: int | str) -> DataFrame:
    """The central ``size`` by ``size`` pixels of each frame, renumbered from 0; ``full`` leaves frames as they are.

    A frame smaller than that makes the query fail.
    """
    if str(size).lower() == "full":
        return pixels
    n = int(size)
    ends = pixels.groupBy("frame_id").agg((F.max("i") + 1).alias("_m"), (F.max("j") + 1).alias("_n"))
    small = F.raise_error(F.concat(F.lit(f"a crop of {n} pixels is larger than frame "), F.col("frame_id").cast("string")))
    ends = ends.withColumn("_n", F.when((F.col("_m") < n) | (F.col("_n") < n), small.cast("int")).otherwise(F.col("_n")))
    p = pixels.join(ends, "frame_id")
    p = p.withColumn("i", F.col("i") - F.floor((F.col("_m") - n) / 2).cast("int")).withColumn("j", F.col("j") - F.floor((F.col("_n") - n) / 2).cast("int"))
    return p.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)).drop("_m", "_n")


def multilook(pixels: DataFrame, looks: int) -> DataFrame:
    """Coherent sum of ``(re, im)`` over blocks as a unit phasor, the mean coherence, and whether half the block is valid.

    Valid pixels are unmasked and not zero. A block with fewer than half of them is zero. Rows and columns that do not
    fill a block are left out.
    """
    size = pixels.groupBy("frame_id").agg(F.floor((F.max("i") + 1) / looks).alias("m"), F.floor((F.max("j") + 1) / looks).alias("n"))
    p = pixels.withColumn("bi", F.floor(F.col("i") / looks)).withColumn("bj", F.floor(F.col("j") / looks)).join(size, "frame_id").where("bi < m and bj < n")
    ok = F.col("mask") & ((F.col("re") != 0) | (F.col("im") != 0))
    valid = lambda c: F.sum(F.when(ok, F.col(c)))
    g = p.groupBy("frame_id", "bi", "bj").agg(valid("re").alias("sr"), valid("im").alias("si"), valid("corr").alias("sc"), F.sum(ok.cast("int")).alias("n_valid"))
    half = 2 * F.col("n_valid") >= looks * looks
    length = F.sqrt(F.col("sr") * F.col("sr") + F.col("si") * F.col("si"))
    unit = lambda c: F.when(half & (length > 0), F.col(c) / length).otherwise(0.0)
    corr = F.when(half & (F.col("n_valid") > 0), F.col("sc") / F.col("n_valid")).otherwise(0.0)
    return g.select("frame_id", F.col("bi").cast("int").alias("i"), F.col("bj").cast("int").alias("j"), unit("sr").alias("re"), unit("si").alias("im"), corr.alias("corr"), half.alias("mask"))


def interferogram(first: DataFrame, second: DataFrame, looks: int) -> DataFrame:
    """Multilooked ``second * conj(first)`` and its coherence from two tables ``(frame_id, i, j, re, im)``."""
    b = second.select("frame_id", "i", "j", F.col("re").alias("re2"), F.col("im").alias("im2"))
    p = first.join(b, ["frame_id", "i", "j"]).withColumn("bi", F.floor(F.col("i") / looks).cast("int")).withColumn("bj", F.floor(F.col("j") / looks).cast("int"))
    re = F.col("re2") * F.col("re") + F.col("im2") * F.col("im")
    im = F.col("im2") * F.col("re") - F.col("re2") * F.col("im")
    g = p.groupBy("frame_id", "bi", "bj").agg(F.avg(re).alias("re"), F.avg(im).alias("im"), F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p1"), F.avg(F.col("re2") * F.col("re2") + F.col("im2") * F.col("im2")).alias("p2"))
    power = F.sqrt(F.col("p1") * F.col("p2"))
    corr = F.when(power > 0, F.least(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / power, F.lit(1.0))).otherwise(0.0)
    return g.select("frame_id", F.col("bi").alias("i"), F.col("bj").alias("j"), "re", "im", corr.alias("corr"))


def upsampled(coarse: DataFrame, looks: int, rows: int, cols: int) -> DataFrame:
    """Block replication of ``coarse(frame_id, i, j, v)``; the last cell also covers what is left over."""
    fine = coarse.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    ends = coarse.groupBy("frame_id").agg(F.max("i").alias("mi"), F.max("j").alias("mj"))
    cell = fine.crossJoin(ends).withColumn("ci", F.least(F.floor(F.col("i") / looks), F.col("mi"))).withColumn("cj", F.least(F.floor(F.col("j") / looks), F.col("mj")))
    c = coarse.select("frame_id", F.col("i").alias("ci"), F.col("j").alias("cj"), "v")
    return cell.join(c, ["frame_id", "ci", "cj"]).select("frame_id", "i", "j", "v")


def boundary_pixels(labels: DataFrame, most: int = 2000) -> DataFrame:
    """``(frame_id, label, i, j, rank)``: pixels of a label with a 4-neighbour of another one, thinned to at most ``most``.

    The edge of the image is no boundary. Thinning takes every ``ceil(n / most)``-th pixel in raster order.
    """
    p = labels
    for win, axis, names in ((_row(), "j", "ew"), (_column(), "i", "sn")):
        p = _blocked(p, 1, 1) if axis == "i" else p
        for name, step in zip(names, (1, -1), strict=True):
            p = p.withColumn(name, F.when(F.lead(axis, step).over(win) == F.col(axis) + step, F.lead("label", step).over(win)))
    p = _unblocked(p)
    differs = [F.coalesce(F.col(c) != F.col("label"), F.lit(False)) for c in "ewsn"]
    edge = p.where((F.col("label") > 0) & (differs[0] | differs[1] | differs[2] | differs[3]))
    by = Window.partitionBy("frame_id", "label")
    edge = edge.withColumn("rank", F.row_number().over(by.orderBy("i", "j")) - 1).withColumn("n", F.count("*").over(by))
    return edge.where(F.col("rank") % F.ceil(F.col("n") / most) == 0).select("frame_id", "label", "i", "j", "rank")


def high_coherence_cuts(cuts: DataFrame, threshold: float = 0.7, dilate: int = 1) -> DataFrame:
    """Pixels ``(frame_id, i, j)`` of cut edges ``(frame_id, dir, i, j, corr, flow)`` with high coherence, and around them."""
    hit = cuts.where((F.col("flow") != 0) & (F.col("corr") > threshold))
    down, over = (F.col("dir") == "v").cast("int"), (F.col("dir") == "h").cast("int")
    pixels = hit.select("frame_id", "i", "j").unionByName(hit.select("frame_id", (F.col("i") + down).alias("i"), (F.col("j") + over).alias("j")))
    plus = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-dilate, dilate + 1) for b in range(-dilate, dilate + 1) if abs(a) + abs(b) <= dilate))
    return pixels.select("frame_id", "i", "j", F.explode(plus).alias("s")).select("frame_id", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct()


def itoh(pixels: DataFrame, flow_h: Column | None = None, flow_v: Column | None = None) -> DataFrame:
    """Integration without a mask: cycles ``k`` by prefix sums down column 0, then along each row, and ``unw``.

    ``flow_h`` and ``flow_v`` are net flow corrections of the step onto a pixel from its left and its upper neighbour.
    """
    tau = F.lit(2 * 3.141592653589793)
    zero = F.lit(0)
    step_h = F.coalesce(-cycle_difference(F.col("psi"), F.lag("psi").over(_row())) + (zero if flow_h is None else flow_h), zero)
    up = Window.partitionBy("frame_id", "j").orderBy("i")
    step_v = F.coalesce(-cycle_difference(F.col("psi"), F.lag("psi").over(up)) + (zero if flow_v is None else flow_v), zero)
    p = pixels.withColumn("sh", F.when(F.col("j") > 0, step_h).otherwise(zero))
    k0 = pixels.where("j = 0").withColumn("sv", F.when(F.col("i") > 0, step_v).otherwise(zero)).select("frame_id", "i", F.sum("sv").over(Window.partitionBy("frame_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("k0"))
    p = p.join(k0, ["frame_id", "i"])
    k = F.col("k0") + F.sum("sh").over(_row().rowsBetween(Window.unboundedPreceding, 0))
    return p.select("frame_id", "i", "j", k.cast("int").alias("k"), (F.col("psi") + tau * k).alias("unw"))

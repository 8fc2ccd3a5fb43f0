"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in a fixed pseudo-random order, repeated up to ``EPOCHS`` times. The virtual
finish time of a queued document is its source's cumulative words divided by the source's target. All queues are merged
in the order of that time and cut off where the total budget is used up.

The cumulative sums need no task per source: words are first summed by (source, slot of the order), the sums of the
slots before are added up over that small table, and only the documents of one slot are sorted together. The merge is
cut by the same two steps over slots of virtual time, so that no task sees the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Most times that a document is taken; weights of the sources in their order, repeating; slots of time.
EPOCHS, WEIGHTS, SLOTS = 3, (1, 2, 3), 4096
#: Entries of the merged order that are sorted in one task.
FEW = 20_000


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``, one row per document.

    Sources are in code-point order, null last. Filling by weight: sources are taken by cap/weight; one stays at its cap
    if the level that the rest would then reach is at least its own. Only source rows are in the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = F.lit(0)
    nth = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy(one)
    upto = every.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    left = F.col("total") - (F.sum("most").over(upto) - F.col("most"))
    rest = F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))
    per = per.withColumn("level", left / rest).withColumn("full", F.col("level") >= F.col("ratio"))
    open_level = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(open_level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def order_key(doc_id: Column) -> Column:
    """Pseudo-random place of a document: 60 bits of an MD5, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, ...)``: ``row, doc_id, size, source_size, target, taken``.

    A null text has size 0; null is a source of its own, the last one; a source without words has target 0. Rows that
    share an id are separate documents whose order among each other is set by size, then arbitrary among equals; ``row``
    is a number of its own for each row of ``docs`` in the order that its partitions have them. Other columns are not
    looked at; an empty table gives an empty result.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"))
    return mixed(materialize(own), weights, epochs, slots)


def mixed(own: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS) -> DataFrame:
    """:func:`mix` of ``own(row, doc_id, source, size)``, a written table.

    Rows of a source that share id and size are alike and stand one after another in the queue, in the order of ``row``.
    They may be a third of all rows, so they are one entry of the windows that add up sizes; each row's place among them
    is found from the number of them in each of the partitions that ``row`` was counted in.
    """
    null_safe = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    place = order_key(F.col("doc_id"))
    own = own.withColumn("place", place).withColumn("slot", F.shiftright("place", 48).cast("int")).withColumn("queue", null_safe)
    own = own.withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn("part", F.shiftright("row", 33))
    goal = materialize(targets(own.select("source", "size"), weights, epochs)).withColumn("queue", null_safe)
    alike = ["queue", "slot", "place", "doc", "size"]
    in_part = materialize(own.groupBy(*alike, "part").agg(F.count("*").alias("n")))
    kinds = in_part.groupBy(*alike).agg(F.sum("n").alias("n"))
    by_slot = own.groupBy("queue", "slot").agg(F.sum("size").alias("in_slot"))
    earlier = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = by_slot.withColumn("before", F.coalesce(F.sum("in_slot").over(earlier), F.lit(0).cast("long"))).drop("in_slot")
    in_slot = Window.partitionBy("queue", "slot").orderBy("place", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("upto", F.coalesce(F.sum(F.col("size") * F.col("n")).over(in_slot), F.lit(0).cast("long")))
    kinds = kinds.join(by_slot, ["queue", "slot"]).withColumn("start", F.col("upto") + F.col("before")).drop("upto", "before")
    kinds = materialize(kinds)
    # of those that are alike, the ones in earlier partitions come first; then the row's number among those of its own
    others = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shared = in_part.join(kinds.where("n > 1").select(*alike), alike).withColumn("ahead", F.coalesce(F.sum("n").over(others), F.lit(0).cast("long"))).drop("n")
    within = Window.partitionBy(*alike, "part").orderBy("row")
    many = own.join(materialize(shared), [*alike, "part"]).select("row", (F.col("ahead") + F.row_number().over(within)).alias("nth"))
    own = own.join(kinds, alike).join(materialize(many).withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    queued = own.withColumn("upto", F.col("start") + F.col("size") * F.coalesce("nth", F.lit(1))).join(goal.drop("source"), "queue")
    queued = materialize(queued.select("row", "doc_id", "queue", "place", "size", "source_size", "target", "upto"))
    # one entry per document and epoch, by its virtual finish time
    entries = queued.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("finish", _finish(F.col("epoch")))
    last = _last_served(entries.select("queue", "size", "epoch", "finish", "upto"), goal.agg(F.sum("source_size")).first()[0] or 0, slots)
    served = F.lit(0).cast("long")
    for e in range(epochs):
        if last is not None:
            entry = F.struct(_finish(F.lit(e)).alias("finish"), F.col("queue"), F.lit(e).alias("epoch"), F.col("upto"))
            limit = F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).alias("queue"), F.lit(last[2]).alias("epoch"), F.lit(last[3]).cast("long").alias("upto"))
            served = served + F.when((F.col("size") > 0) & (entry <= limit), 1).otherwise(0)
    return queued.select("row", "doc_id", "size", "source_size", "target", (F.col("size") * served).alias("taken"))


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("upto")) / F.col("target")


def _last_served(entries: DataFrame, budget: int, slots: int) -> tuple | None:
    """``finish, queue, epoch, upto`` of the last entry in that order with which the sum of sizes is within the budget.

    The slot of time that the budget ends in is cut into slots until few entries are left; one row for each slot comes
    to the driver, then one entry. Entries that finish at the very same time are few: at most one per queue and epoch.
    """
    rest, used = entries, 0
    while True:
        ends = rest.agg(F.min("finish").alias("a"), F.max("finish").alias("b"), F.count("*").alias("n"), F.sum("size").alias("size")).first()
        if (ends["size"] or 0) + used <= budget:
            used = -1 << 62  # everything fits
        if ends["n"] <= FEW or ends["a"] == ends["b"] or used < 0:
            break
        width = (ends["b"] - ends["a"]) / slots
        slot = F.least(F.floor((F.col("finish") - ends["a"]) / width), F.lit(slots - 1)).cast("int")
        sums = rest.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"), F.min("finish").alias("a"), F.max("finish").alias("b")).orderBy("slot").collect()
        for row in sums:
            if used + row["size"] > budget:
                break
            used += row["size"]
        # the slot that overflows, with the last one before it in case that none of its entries fits
        at = sums.index(row)
        before = sums[at - 1] if at else row
        used -= before["size"] if at and used + row["size"] > budget else 0
        if before["a"] == ends["a"] and row["b"] == ends["b"]:
            break
        rest = rest.where(F.col("finish").between(before["a"], row["b"]))
    if used < 0:
        found = rest.agg(F.max(F.struct("finish", "queue", "epoch", "upto")).alias("last")).first()["last"]
        return None if found is None else tuple(found)
    order = Window.partitionBy(F.lit(0)).orderBy("finish", "queue", "epoch", "upto").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = rest.withColumn("sum", F.sum("size").over(order) + used).where(F.col("sum") <= budget)
    found = fits.agg(F.max(F.struct("finish", "queue", "epoch", "upto")).alias("last")).first()["last"]
    return None if found is None else tuple(found)


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each with ``size, source_size, target, taken`` (columns of these names are replaced).

    Rows are numbered once, in a written copy, so that rows with equal ids and texts are told apart.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    own = numbered.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.source", words_in(F.col("doc.text")).alias("size"))
    made = ("size", "source_size", "target", "taken")
    taken = mixed(materialize(own)).where("taken > 0").select("row", *made)
    return numbered.join(taken, "row").select(*(F.col("doc")[c].alias(c) for c in docs.columns if c not in made), *made)

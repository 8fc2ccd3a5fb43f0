"""Preference formatting: one shared prompt and a masked completion each for a chosen and a rejected conversation.

All in DataFrame operations. The turns of both sides are lined up by position with an equi-join, the first position
where they differ is a partially aggregated minimum, and everything before it is the prompt, rendered once. Turns are
collected only within a pair and in parts of at most ``PART`` turns, so that a very long conversation never sits in one
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Marks around a rendered turn.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Most turns in one row of the result.
PART = 512


def rendered(role: Column, text: Column) -> Column:
    """A turn with its marks; a null role or text is rendered as empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def positions(turns: DataFrame) -> DataFrame:
    """``(pair, side, turn, role, text)`` with ``at``, the place in the conversation from 0.

    Turns are ordered by number (null first), then by role and text, so that repeated numbers have a defined order.
    """
    by = Window.partitionBy("pair", "side").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return turns.withColumn("at", F.row_number().over(by) - 1)


def format_preferences(chosen: DataFrame, rejected: DataFrame, part: int = PART) -> DataFrame:
    """One row per pair, side and part from two tables ``(pair, turn, role, text)``.

    Columns: ``pair, kind`` (prompt, chosen or rejected), ``part`` (from 0), ``n_turns``, ``text`` and ``masks``: the
    ``[start, end)`` code points of ``text`` that a model is trained on, which are the assistant's turns with their end
    marks, in completions only. ``prompt`` is the longest common prefix of turns (equal role and text; nulls are equal).
    A side without turns after the prefix, or that is missing, has one row with an empty text; so has an empty prefix.
    Parts of one kind joined in order are the whole text. Rows with a null pair are a pair of their own.
    """
    both = positions(chosen.select("pair", F.lit("chosen").alias("side"), "turn", "role", "text").unionByName(rejected.select("pair", F.lit("rejected").alias("side"), "turn", "role", "text")))
    turn = F.xxhash64("role", "text")
    side = lambda s: F.col("side") == s
    # both sides have a position: two rows there; they agree if role and text do
    lined = both.groupBy("pair", "at").agg(
        F.count("*").alias("n"), F.min(turn).alias("a"), F.max(turn).alias("b"), F.min(F.struct("role", "text")).alias("x"), F.max(F.struct("role", "text")).alias("y")
    )
    differs = (F.col("n") < 2) | (F.col("a") != F.col("b")) | ~F.col("x").eqNullSafe(F.col("y"))
    ends = lined.groupBy("pair").agg(F.min(F.when(differs, F.col("at"))).alias("first"), (F.max("at") + 1).alias("length"))
    ends = ends.select(F.col("pair").alias("p"), F.coalesce("first", "length").alias("shared"))
    marked = both.join(ends, F.col("pair").eqNullSafe(F.col("p"))).drop("p")
    prompt = F.col("at") < F.col("shared")
    rows = marked.where(~prompt | side("chosen"))
    kind = F.when(prompt, "prompt").otherwise(F.col("side"))
    place = F.when(prompt, F.col("at")).otherwise(F.col("at") - F.col("shared"))
    rows = rows.select("pair", kind.alias("kind"), F.floor(place / part).cast("int").alias("part"), "at", rendered(F.col("role"), F.col("text")).alias("turn_text"), (~prompt & F.col("role").eqNullSafe(F.lit("assistant"))).alias("train"))
    rows = rows.withColumn("lead", F.length(F.lit(START)) + F.length(F.lit("assistant\n")))
    got = rows.groupBy("pair", "kind", "part").agg(F.array_sort(F.collect_list(F.struct("at", "turn_text", "train", "lead"))).alias("turns"))
    size = F.transform("turns", lambda t: F.length(t["turn_text"]))
    got = got.withColumn("sizes", size)
    spans = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.struct(
                t["train"].alias("train"),
                (_sum(F.slice("sizes", F.lit(1), i)) + t["lead"]).cast("long").alias("start"),
                _sum(F.slice("sizes", F.lit(1), i + 1)).cast("long").alias("end"),
            ),
        ),
        lambda s: s["train"],
    )
    masks = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    got = got.select("pair", "kind", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("text"), masks.alias("masks"))
    # the kinds of a pair that have no turn
    kinds = ends.select(F.col("p").alias("pair"), F.explode(F.array(*map(F.lit, ("prompt", "chosen", "rejected")))).alias("kind"))
    there = got.where("part = 0").select(F.col("pair").alias("q"), F.col("kind").alias("k"))
    none = kinds.join(there, F.col("pair").eqNullSafe(F.col("q")) & (F.col("kind") == F.col("k")), "left_anti")
    empty = none.select("pair", "kind", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n_turns"), F.lit("").alias("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))
    return got.unionByName(empty)


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)


def last_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chosen and a rejected table from logged conversations ``(conv_id, turn, role, text)``.

    Chosen is the conversation as logged. In the rejected one the last assistant turn says what the assistant said the
    time before, which does not answer the last question; with a single assistant turn it says nothing. A conversation
    without an assistant turn is rejected as it stands.
    """
    turns = conversations.select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    replies = turns.where("role = 'assistant'").groupBy("pair").agg(F.max("turn").alias("last"))
    replies = replies.withColumnRenamed("pair", "p")
    earlier = turns.where("role = 'assistant'").join(replies, F.col("pair").eqNullSafe(F.col("p"))).where("turn < last").groupBy("p").agg(F.max(F.struct("turn", "text")).alias("before"))
    known = replies.join(earlier.withColumnRenamed("p", "p2"), F.col("p").eqNullSafe(F.col("p2")), "left").select("p", "last", F.col("before.text").alias("before"))
    joined = turns.join(known, F.col("pair").eqNullSafe(F.col("p")), "left")
    swap = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    text = F.when(swap, F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    return turns, joined.select("pair", "turn", "role", text.alias("text"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = last_reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = format_preferences(chosen, rejected)
    spans = F.array_join(F.transform("masks", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.select(F.col("pair").alias("conv_id"), "kind", "part", "n_turns", "text", spans.alias("masks"))

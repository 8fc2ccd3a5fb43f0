"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word k-gram of a text is hashed and joined to the places of the same k-gram in the license templates. A
match votes for the diagonal ``text position - template position``. Votes are counted per diagonal and neighbouring
diagonals (a few words inserted or left out) are merged, in bands and in chains. The span that a merged match covers is
verified as a whole: its words at the votes are the template's, each word of the text stands for one of the template's at
most, and those found must be ``SHARE`` of the template's words.

A text is cut into words once. What is written of it is its number of words and its hits, which are the k-grams that some
template has, with their ``K`` words; nothing after that reads the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Words in a k-gram; diagonals at most this far apart belong to one match; least share of a template's k-grams and words,
#: for templates of at least so many words. Shorter ones match only whole.
K, DRIFT, SHARE, LONG = 2, 3, 0.6, 10

#: The phrases whose every place is counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening sentences of common licenses, and the labels that a long enough part of them gives.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}

_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), *_LOWER)


def license_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(ascii_lower(text), _WORD), "")


def template_grams(spark: SparkSession) -> DataFrame:
    """``(hash, template, label, is_base, n, at, words)``: a few hundred rows, for the broadcast side of the join."""
    rows = [(i, text, label, base) for i, (text, label, base) in enumerate([*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for t, x in TEMPLATES.items())])]
    t = spark.createDataFrame(rows, "template int, text string, label string, is_base boolean").withColumn("words", F.split("text", " "))
    t = t.withColumn("n", F.size("words")).select("*", F.posexplode(_grams(F.col("words"))).alias("at", "hash"))
    return t.select("hash", "template", "label", "is_base", "n", "at", "words")


def _grams(words: Column) -> Column:
    """Hashes of all rolling K-grams, by position."""
    last = F.size(words) - K
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(K))))


def scanned(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, n_words, hits)`` per row of ``docs``, written once; ``row`` is a number of its own for each row."""
    known = [r.hash for r in template_grams(docs.sparkSession).select("hash").distinct().collect()]  # as many as TEMPLATES has k-grams
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), license_words(F.col("text")).alias("words"))
    places = F.filter(F.transform(_grams(F.col("words")), lambda h, i: F.struct(h.alias("hash"), i.alias("pos"))), lambda x: x["hash"].isin(known))
    hits = F.transform(places, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"), F.slice("words", x["pos"] + 1, K).alias("gram")))
    return materialize(words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")))


def license_matches(found: DataFrame) -> DataFrame:
    """Verified matches ``(row, template, label, is_base, first, last, share)`` of ``found`` (as :func:`scanned` returns it).

    A base phrase matches where its words stand consecutively. Another template matches where its words stand
    consecutively or, from ``LONG`` words, where at least ``SHARE`` of its k-grams vote for diagonals no more than
    ``DRIFT`` words apart and ``SHARE`` of its words are verified there.
    """
    grams = template_grams(found.sparkSession)
    placed = found.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = placed.join(F.broadcast(grams.withColumnRenamed("words", "expected")), "hash").withColumn("diagonal", F.col("pos") - F.col("at"))
    # the words at the votes are compared, so that equal hashes of different words do not count
    votes = votes.where(F.col("gram") == F.slice(F.col("expected"), F.col("at") + 1, K))
    one = votes.groupBy("row", "template", "label", "is_base", "n", "diagonal").agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    one = one.withColumn("votes", F.size("ats")).withColumn("cells", F.transform("ats", lambda x: F.struct(x.alias("at"), (x + F.col("diagonal")).alias("pos"))))
    long = one.where(~F.col("is_base") & (F.col("n") >= LONG))
    return _exact(one).unionByName(_joined(_banded(long).unionByName(_merged(long))))


def _verified(cells: Column) -> Column:
    """Words of the template that the votes ``(at, pos)`` find, each in a word of the text that stands for no other one."""
    words = lambda field: F.size(F.array_distinct(F.flatten(F.transform(cells, lambda x: F.sequence(x[field], x[field] + K - 1)))))
    return F.least(words("at"), words("pos"))


def _exact(one: DataFrame) -> DataFrame:
    """Diagonals that all k-grams of the template vote for: its words stand there consecutively."""
    full = one.where(F.col("votes") == F.col("n") - (K - 1))
    return full.select("row", "template", "label", "is_base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("n") - 1).alias("last"), F.lit(1.0).alias("share"))


def _banded(one: DataFrame) -> DataFrame:
    """Diagonals at most DRIFT above each diagonal as one match, whatever votes lie between; only parts of the template."""
    by = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    all_ats = F.flatten(F.collect_list("ats").over(by))
    bands = one.select(
        "row", "template", "label", "is_base", "n", F.size(F.array_distinct(all_ats)).alias("votes"), F.max("votes").over(by).alias("best"),
        F.flatten(F.collect_list("cells").over(by)).alias("cells"), F.min("first").over(by).alias("from"), F.max("last").over(by).alias("to"),
    )
    share = F.col("votes") / (F.col("n") - (K - 1))
    part = bands.withColumn("share", share).where((F.col("share") >= SHARE) & (F.col("best") < F.col("n") - (K - 1)))
    part = part.where(_verified(F.col("cells")) >= SHARE * F.col("n"))
    return part.select("row", "template", "label", "is_base", F.col("from").alias("first"), (F.col("to") + K - 1).alias("last"), "share")


def _joined(parts: DataFrame) -> DataFrame:
    """Matches of a template that overlap as one, with the largest share."""
    by = Window.partitionBy("row", "template").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("first") > reach).cast("int"), F.lit(0))
    placed = parts.withColumn("new", new).withColumn("place", F.sum("new").over(by))
    out = placed.groupBy("row", "template", "label", "is_base", "place").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("share").alias("share"))
    return out.drop("place")


def _merged(one: DataFrame) -> DataFrame:
    """Neighbouring diagonals as one match; the spans that are only a part of the template."""
    by = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > DRIFT) | (F.col("first") - F.lag("last").over(by) > F.col("n"))
    grouped = one.withColumn("chain", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(by))
    chains = grouped.groupBy("row", "template", "label", "is_base", "n", "chain").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("votes").alias("best"), F.flatten(F.collect_list("cells")).alias("cells"))
    share = F.col("votes") / (F.col("n") - (K - 1))
    part = chains.withColumn("share", share).where((F.col("share") >= SHARE) & (F.col("best") < F.col("n") - (K - 1)))
    span = F.col("last") + K - F.col("first")  # votes this far apart are no one copy; nearer ones among them are a band
    part = part.where((span <= F.col("n") * 2) & (_verified(F.col("cells")) >= SHARE * F.col("n")))
    return part.select("row", "template", "label", "is_base", "first", (F.col("last") + K - 1).alias("last"), F.least("share", F.lit(1.0)).alias("share"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts of the base phrases, labels and a score.

    ``n_base``, ``first_word`` and ``last_word`` are over all places of the base phrases; ``base_labels`` are theirs and
    ``labels`` all, distinct, sorted and comma-joined (empty: none); ``score`` is the largest share of a template's
    k-grams that a match has (0: none). A null text has no words. Rows that share an id, null ids too, are separate.
    Other columns are not looked at; an empty table gives an empty result.
    """
    own = scanned(docs)
    found = license_matches(own)
    base = F.col("is_base")
    per = found.groupBy("row").agg(
        F.count_distinct(F.when(base, F.struct("template", "first"))).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    out = own.select("row", "doc_id", "n_words").join(per, "row", "left")
    zero, none = F.lit(0).cast("long"), F.lit("")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

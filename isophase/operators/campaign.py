"""Campaign analytics: joins, deduplication, sampling and roll-ups of per-frame records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_key(name: Column) -> Column:
    """A file name without ``.h5`` or ``.hdf5`` (any case), dots as underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.(h5|hdf5)$", ""), r"\.", "_")


def last_per_key(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """The last row of each key in ingestion order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(sequence).desc()))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def merge_runs(results: DataFrame, runs: DataFrame, key: str = "key") -> DataFrame:
    """Results with the record of their run, where there is one (left join on the normalised key)."""
    return results.join(runs, key, "left")


def with_derived(merged: DataFrame) -> DataFrame:
    mega = F.col("num_pixels") / 1e6
    return merged.withColumn("megapixels", mega).withColumn("gb_per_mpx", F.col("peak_rss_mb") / 1024 / mega)


def join_land(inventory: DataFrame, land: DataFrame, least_land: float) -> DataFrame:
    """Frames of the inventory that are on land, joined on track, frame and direction."""
    return inventory.join(land.where(F.col("fraction_land") >= least_land), ["track", "frame", "direction"])


def within_dates(inventory: DataFrame, first, last, column: str = "ref_time") -> DataFrame:
    return inventory.where(F.col(column).between(F.lit(first), F.lit(last)))


def one_per_frame(inventory: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each frame; whole rows, so a null in it stays a null."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return inventory.withColumn("_n", nth).where("_n = 1").drop("_n")


def sample_per_track(frames: DataFrame, per_track: int, keys: list[str], order: list[str]) -> DataFrame:
    """Evenly spread positions of each track: place ``rint((i + 1) * (n - 1) / (per_track + 1))``, each place once.
    :func:`shuffled` puts what it takes in a random order."""
    part = Window.partitionBy(*keys)
    ranked = frames.withColumn("_at", F.row_number().over(part.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(part))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(per_track - 1)), lambda i: F.rint((i + 1) * (F.col("_n") - 1) / F.lit(per_track + 1)).cast("long"))
    return ranked.where(F.array_contains(wanted, F.col("_at").cast("long"))).drop("_at", "_n")


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """``rows`` with ``place``, their place from 0 in a pseudo-random order that the seed and the key set."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    return hashed.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *key)) - 1).drop("_h")


def with_missing(wanted: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``wanted`` with their record in ``known``, and the keys that have none."""
    return wanted.join(known, key), wanted.join(known, key, "left_anti").select(key)


def usual(results: DataFrame, value: str) -> DataFrame:
    """``(value, n)``: the most frequent value, the smallest of equally frequent ones; nulls do not count."""
    counts = results.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(value).asc()).limit(1)


def worst(results: DataFrame, score: str, n: int, tie: str) -> DataFrame:
    return results.orderBy(F.col(score).asc(), F.col(tie).asc()).limit(n)


def slowest_unique(results: DataFrame, key: str, runtime: str, least: float, n: int, tie: str | None = None) -> DataFrame:
    """Rows from a runtime on, the slowest of each key (of equal ones the first by ``tie``), the ``n`` slowest of those."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(runtime).desc(), *([F.col(tie).asc()] if tie else [])))
    return results.where(F.col(runtime) >= least).withColumn("_n", nth).where("_n = 1").drop("_n").orderBy(F.col(runtime).desc(), key).limit(n)


def tier(score: Column) -> Column:
    return F.when(score >= 0.99, "good").when(score >= 0.90, "fair").otherwise("poor")


def ecdf(values: DataFrame, value: str, partition: str | None = None) -> DataFrame:
    """Share of rows with at most each value. Without a partition the values are first counted, so that the window runs
    over distinct values only."""
    keys = [partition] if partition else []
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*keys, value, (upto / F.sum("n").over(part)).alias("ecdf"))


def summary(results: DataFrame, score: str, runtime: str) -> DataFrame:
    return results.agg(
        F.count("*").alias("n"), F.median(score).alias("median_score"), F.avg(score).alias("mean_score"), F.min(score).alias("least_score"),
        F.avg((F.col(score) >= 0.99).cast("double")).alias("share_good"), F.median(runtime).alias("median_runtime"), F.percentile(runtime, F.lit(0.9)).alias("p90_runtime"),
    )


def most_frequent(rows: DataFrame, keys: list[str], value: str, not_after: str | None = None) -> DataFrame:
    """Most frequent value per key; among equals the latest that is not after ``not_after``, else the latest."""
    counts = rows.groupBy(*keys, value, *([not_after] if not_after else [])).agg(F.count("*").alias("n"))
    early = (F.col(value) <= F.col(not_after)).cast("int") if not_after else F.lit(1)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), early.desc(), F.col(value).desc()))
    return counts.withColumn("_n", nth).where("_n = 1").drop("_n", *([not_after] if not_after else []))


def to_do(manifest: DataFrame, done_log: DataFrame, done_results: DataFrame, key: str) -> DataFrame:
    """Entries of the manifest that neither a successful run nor a result is known of."""
    done = done_log.where("returncode = 0").select(key).union(done_results.select(key)).distinct()
    return manifest.join(done, key, "left_anti")


def parsed_granules(names: DataFrame, column: str, pattern: str, fields: dict[str, tuple[int, str]], strict: bool = True) -> DataFrame:
    """Fields of a name by regular expression; with ``strict``, a name that does not match is an error."""
    ok = F.col(column).rlike(pattern)
    checked = F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("cannot parse "), F.col(column))) if strict else F.lit(None))
    return names.withColumn(column, checked).select("*", *(F.regexp_extract(column, pattern, g).cast(kind).alias(name) for name, (g, kind) in fields.items()))


def manifest(lines: DataFrame) -> DataFrame:
    """Entries of a text manifest ``(value)``: what is before ``#``, trimmed, without blanks."""
    return lines.select(F.trim(F.split("value", "#")[0]).alias("entry")).where("entry <> ''")

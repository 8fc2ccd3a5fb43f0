"""Run logs as a stream: each new file of an append-only JSON-lines log is handled once, also over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNS = "job_id string, input string, returncode int, wall_s double, peak_rss_mb double, started_utc timestamp, workers int, threads_per_worker int"


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUNS).json(path)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all new rows to ``handle(batch, batch_id)`` and stop; a second call without new files does nothing."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

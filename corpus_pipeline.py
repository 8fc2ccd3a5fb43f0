"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isophase.llm.common import materialize
from isophase.llm.decontaminate import stage_decontaminate
from isophase.llm.mixing import stage_mix
from isophase.llm.quality_dsir import stage_quality
from isophase.llm.simhash import stage_simhash
from isophase.llm.suffix_dedup import stage_suffix_dedup

STAGES = [
    ("quality", stage_quality),
    ("simhash", stage_simhash),
    ("suffix_dedup", stage_suffix_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]

#: The fitted and hashed stages have no SQL form; tests compare every stage's rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

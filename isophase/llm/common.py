"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master; elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="isophase-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/isophase-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _CREATED:
        _CREATED[root] = spark
        atexit.register(release, spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what :func:`materialize` wrote in this application; results that still read it become invalid."""
    try:
        root = shared_dir(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has already ended; nothing is left to clean with
        pass


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing reads any more, and let Spark clean their shuffles."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if shared_dir(spark).split(":", 1)[-1].lstrip("/") in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()  # shuffle files go when the driver's references to them do


def row_key(doc_id: Column, text: Column, names: tuple[str, str] = ("k1", "k2")) -> list[Column]:
    """128 bits that name a row by its id and whole text, as two independently seeded 64-bit hashes.

    Rows that share an id (null ids too) have different names if their texts differ; rows with the same id and text have
    one name, and the operators give them equal results. A null text counts as empty.
    """
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(seed), doc_id.isNull(), doc_id, body).alias(name) for seed, name in zip((0x1F3D5B79, 0x2A4C6E80), names, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Campaign inputs: result files, tables with a header, lists of inputs; names of outputs by their extension."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of TIFF files.
_TIFF = {".tif", ".tiff"}


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """The records of ``<root>/results/<product>/<crop>.json``, one a file, with ``product``, ``crop`` and ``json_path``.

    A record's own product and crop come first, the names of its folder and file fill in. No file is an error.
    """
    df = spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/results/*/*.json")
    parts = F.split("json_path", "/")
    df = df.withColumn("json_path", F.input_file_name())
    names = {"product": F.element_at(parts, -2), "crop": F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")}
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), x) if c in df.columns else x for c, x in names.items()})


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def resolve_inputs(inputs: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, nth)``: the files that ``inputs(nth, entry)`` name, each once, in the order of its first entry.

    An entry names ``files(path)`` that are it or lie below it; a name that no file has is an error.
    """
    below = (F.col("path") == F.col("entry")) | F.startswith("path", F.concat(F.rtrim("entry", F.lit("/")), F.lit("/")))
    met = inputs.join(files, below, "left")
    known = F.coalesce("path", F.raise_error(F.concat(F.lit("no such input: "), F.col("entry"))).cast("string"))
    return met.select(known.alias("path"), "nth").groupBy("path").agg(F.min("nth").alias("nth"))


def output_format(path: str, wanted: str = "auto") -> str:
    """tiff, altline or float; ``auto`` goes by the extension."""
    if wanted != "auto":
        return wanted
    kind = PurePosixPath(path).suffix.lower()
    return "tiff" if kind in _TIFF else "altline" if kind == ".unw" else "float"


def components_path(path: str, wanted: str = "auto") -> str:
    """Where the components of an output go by default."""
    if output_format(path, wanted) != "tiff":
        return f"{path}.conncomp"
    p = PurePosixPath(path)
    return str(p.with_suffix(f".conncomp{p.suffix if p.suffix.lower() in _TIFF else '.tif'}"))

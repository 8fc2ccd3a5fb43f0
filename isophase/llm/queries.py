"""The queries of this subpackage and the SQL that some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .debruijn import op7_substring_dedup
from .decontaminate import op10_decontaminate
from .license_scan import op2_license_scan
from .mixing import op8_mix
from .preference import op5_preferences
from .quality_dsir import op4_quality
from .simhash import op1_simhash
from .suffix_dedup import op6_suffix_dedup
from .url_filter import op3_url_filter
from .weak_rules import op9_quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_license_scan, op3_url_filter, op4_quality, op5_preferences, op6_suffix_dedup, op7_substring_dedup, op8_mix, op9_quality_rules, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

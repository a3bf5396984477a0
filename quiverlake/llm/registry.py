"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import ORACLE_SQL, run

from .decontamination import OP10_SQL, op10_benchmark_decontamination
from .language import op5_language_id
from .licenses import op2_license_scan
from .packing import op1_packing
from .perplexity import op4_lm_scoring
from .quality import OP9_SQL, op9_quality_rules
from .sharding import op8_sharding
from .simhash import op6_simhash_near_dedup
from .substrings import op3_suffix_array_dedup
from .urls import OP7_SQL, op7_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_packing, op2_license_scan, op3_suffix_array_dedup, op4_lm_scoring, op5_language_id, op6_simhash_near_dedup, op7_url_filter, op8_sharding, op9_quality_rules, op10_benchmark_decontamination]
    return {f.__name__: f for f in found} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    found = {"op7_url_filter": OP7_SQL, "op9_quality_rules": OP9_SQL, "op10_benchmark_decontamination": OP10_SQL}
    return found | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})

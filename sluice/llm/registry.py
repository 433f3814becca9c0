"""The queries of this subpackage. None has an SQL equivalent: they are tested against brute force in tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_byte_level_bpe
from .decontaminate import op5_benchmark_decontamination
from .language import op3_language_id
from .media import op10_media_columns
from .quality import op6_quality_classifier
from .secrets import op1_secret_scans
from .sharding import op9_consistent_hash_sharding
from .simhash import op7_simhash_near_dedup
from .token_count import op2_token_counts
from .token_store import op4_token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scans, op2_token_counts, op3_language_id, op4_token_store, op5_benchmark_decontamination, op6_quality_classifier, op7_simhash_near_dedup, op8_byte_level_bpe, op9_consistent_hash_sharding, op10_media_columns)
}
SQL: dict[str, str] = {}

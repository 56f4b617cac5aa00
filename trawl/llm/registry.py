"""Queries of the training-data operators and the SQL that checks them, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .minhash import ORACLE as NEAR_SQL
from .minhash import op1_near_dedup
from .ngram_lm import op8_ngram_lm
from .orc_tokens import op5_orc_tokens
from .cap_filters import ORACLE as CAPS_SQL
from .cap_filters import op6_embedding_dedup
from .line_crf import BASE_ORACLE, line_base_counts, op3_line_rules
from .packing import op9_packing
from .preferences import ORACLE as PREFERENCES_SQL
from .preferences import op7_preferences
from .sharding import ORACLE as SHARDING_SQL
from .sharding import op10_sharding
from .weak_quality import op2_quality

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_quality": op2_quality,
        "op3_line_rules": op3_line_rules,
        "op4_bpe": op4_bpe,
        "op5_orc_tokens": op5_orc_tokens,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_preferences": op7_preferences,
        "op8_ngram_lm": op8_ngram_lm,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "line_base_counts": line_base_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": NEAR_SQL,
        "op6_embedding_dedup": CAPS_SQL,
        "op7_preferences": PREFERENCES_SQL,
        "op10_sharding": SHARDING_SQL,
        "line_base_counts": BASE_ORACLE,
    }

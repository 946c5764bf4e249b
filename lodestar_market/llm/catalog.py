"""The registry of the corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_hash_prefix_forest
from .byte_pairs import op8_byte_pairs
from .collocations import COLLOCATIONS_SQL, op11_collocations
from .decontamination import op9_decontamination
from .hard_negatives import NEGATIVES_SQL, op12_hard_negatives
from .html_text import op13_main_text
from .licenses import LICENSE_SQL, op1_licenses
from .lines import LINES_SQL, LONG_LINES_SQL, op3_lines, op3_long_lines
from .near_duplicates import op2_simhash
from .sharding import op6_sharding
from .suffixes import op10_suffixes
from .token_shards import op5_token_shards
from .toxicity import op7_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": op1_licenses,
        "op2_simhash": op2_simhash,
        "op3_lines": op3_lines,
        "op3_long_lines": op3_long_lines,
        "op4_hash_prefix_forest": op4_hash_prefix_forest,
        "op5_token_shards": op5_token_shards,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_byte_pairs": op8_byte_pairs,
        "op9_decontamination": op9_decontamination,
        "op10_suffixes": op10_suffixes,
        "op11_collocations": op11_collocations,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_main_text": op13_main_text,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": LICENSE_SQL,
        "op3_lines": LINES_SQL,
        "op3_long_lines": LONG_LINES_SQL,
        "op11_collocations": COLLOCATIONS_SQL,
        "op12_hard_negatives": NEGATIVES_SQL,
    }

"""The corpus operators' queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_ivfpq_neighbours
from .chat import ORACLE as CHAT_SQL
from .chat import op8_chat_prefix_targets
from .group_join import ORACLE as GROUP_JOIN_SQL
from .group_join import op10_group_join
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import op1_line_dedup
from .matroska import op7_matroska
from .mixing import op6_source_mixing
from .pii import op3_pii
from .quality import op5_quality_rules
from .token_counts import op9_token_counts
from .unigram_scan import op2_sentencepiece_scan


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_line_dedup, op2_sentencepiece_scan, op3_pii, op4_ivfpq_neighbours, op5_quality_rules, op6_source_mixing, op7_matroska, op8_chat_prefix_targets, op9_token_counts, op10_group_join]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op8_chat_prefix_targets": CHAT_SQL, "op10_group_join": GROUP_JOIN_SQL}

"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import op8_bpe
from graphloom.llm.decontamination import op9_decontamination
from graphloom.llm.language_id import op2_language_id
from graphloom.llm.line_dedup import OP5_SQL, op5_line_dedup
from graphloom.llm.ngram_join import OP1_SQL, op1_ngram_jaccard_join
from graphloom.llm.quality import op3_quality_rules
from graphloom.llm.secret_scan import op6_secret_scan
from graphloom.llm.sharding import OP7_SQL, op7_minimax_shards
from graphloom.llm.substring_dedup import op4_substring_dedup
from graphloom.llm.toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op2_language_id": op2_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op10_toxicity": op10_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_bpe": op8_bpe,
    "op9_decontamination": op9_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op5_line_dedup": OP5_SQL,
    "op7_minimax_shards": OP7_SQL,
}

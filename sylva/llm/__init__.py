"""Operators that a training-data pipeline needs: one module an operator, each with query(spark, sf_dir) and SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module.
OPERATORS = {
    "op1_bpe": "op01_bpe",
    "op2_shards": "op02_shards",
    "op3_quality": "op03_quality",
    "op4_ngram_join": "op04_ngram_join",
    "op5_licenses": "op05_licenses",
    "op6_lm": "op06_lm",
    "op7_token_counts": "op07_token_counts",
    "op8_pii": "op08_pii",
    "op9_mix": "op09_mix",
    "op10_exact_dedup": "op10_exact_dedup",
    "op11_prefix_trie": "op11_prefix_trie",
    "op12_alignment": "op12_alignment",
    "op13_suffixes": "op13_suffixes",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"sylva.llm.{module}").query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"sylva.llm.{module}").SQL for name, module in OPERATORS.items()}
    return {name: sql for name, sql in found.items() if sql}

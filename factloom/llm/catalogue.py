"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, chat, classifier, licenses, line_dedup, ngram_join, packing, rules, token_files, topk

MODULES = (bpe, chat, classifier, topk, packing, licenses, rules, token_files, line_dedup, ngram_join)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}

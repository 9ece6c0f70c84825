"""A corpus pipeline of five stages; each stage's rows are written and read again by the next.

Stages filter or edit the columns of `documents`, and the last packs what is left into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import classifier, line_dedup, ngram_join, packing, rules
from factloom.llm.common import cut, drop, made, prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels")
    model = classifier.learn(docs, labels, ~classifier.held_out(labels["doc_id"]))
    return classifier.score(docs, model, into="_score").where("_score >= 0.5").select(*COLUMNS)


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return rules.judge(docs).where("verdict.kept").select("row.*").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those that lose all lines go. A doc_id with several texts is as many documents."""
    kept = line_dedup.dedup_lines(docs).where("NOT emptied")
    return kept.select("row.doc_id", "text", "row.lang", "row.source", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the least doc_id; null ones come last, ties by the text's hash, and of
    rows that repeat id and text one stays. Rows without words stay."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences of at most 1024 tokens."""
    import public_tokenizers as public

    prepare(spark)
    return packing.digest(packing.pack(docs, public.path("byte_bpe_50k.json"), public.PATTERN, added=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("quality rules", keep_by_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
            drop(spark, since)  # what the stage before wrote, and this one on its way
    return docs


#: The classifier and the joins can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None

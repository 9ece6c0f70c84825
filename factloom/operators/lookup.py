"""Point lookups and incremental scans over the fact view: filters that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.spine import chains


def by_id(rows: DataFrame, id: str) -> DataFrame:
    return rows.where(F.col("id") == id)


def hydrate(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some ids; Spark broadcasts the ids where they are few."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def embedding_of(facts: DataFrame, id: str) -> DataFrame:
    return by_id(facts, id).select("embedding")


def latest_after(facts: DataFrame, cursor: int | None = None) -> DataFrame:
    """Latest facts past a cursor, in order of their sequence numbers."""
    rows = facts.where("is_latest = 1")
    return (rows if cursor is None else rows.where(F.col("seq") > cursor)).orderBy("seq")


def slots_touched(facts: DataFrame, cursor: int | None = None) -> DataFrame:
    """Slots with any fact, latest or not, past a cursor."""
    rows = facts if cursor is None else facts.where(F.col("seq") > cursor)
    return rows.select("subject_id", "predicate").distinct()


def latest_in_slot(facts: DataFrame, subject_id: str, predicate: str) -> DataFrame:
    """Current facts of a slot, cold ones too."""
    return facts.where((F.col("subject_id") == subject_id) & (F.col("predicate") == predicate) & (F.col("is_latest") == 1))


def with_subject(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with their subject's name."""
    return facts.join(entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name")), "subject_id")


def fact_detail(facts: DataFrame, entities: DataFrame, episodes: DataFrame, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A fact with its subject, its whole chain (oldest first), and its episode."""
    fact = by_id(with_subject(facts, entities), id)
    steps = chains(facts.select("id", "superseded_by"), facts.where(F.col("id") == id).select("id"))
    chain = steps.select("id", "step").join(facts, "id").orderBy("step", "id")
    return fact, chain, episodes.join(fact.select(F.col("episode_id").alias("id")), "id", "left_semi")


def list_episodes(episodes: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    size = min(max(page_size, 1), 200)
    return episodes.orderBy(F.desc("t_ref"), F.desc("id")).offset((max(page, 1) - 1) * size).limit(size)


def episode_facts(episodes: DataFrame, facts: DataFrame, id: str) -> DataFrame:
    return by_id(episodes, id).select(F.col("id").alias("episode_id")).join(facts, "episode_id").orderBy("seq")


def stale_summaries(derivations: DataFrame, facts: DataFrame, closed: DataFrame) -> DataFrame:
    """Latest summaries that derive from a closed fact."""
    ids = derivations.join(closed.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("summary_id").alias("id")).distinct()
    return facts.where("is_latest = 1").join(ids, "id", "left_semi")


def retired_values(facts: DataFrame, old: str, new: str) -> DataFrame:
    """Facts that speak of the old value and not of the new one."""
    text = F.lower("fact_text")
    return facts.where(F.contains(text, F.lit(old.lower())) & ~F.contains(text, F.lit(new.lower())))

"""Inspection queries over facts, entities, episodes and events, for all namespaces at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import query_terms, search_tokens


def overview(facts: DataFrame, entities: DataFrame | None = None, episodes: DataFrame | None = None) -> DataFrame:
    """Latest, retired and superseding counts of each namespace, in one pass, with those of entities and episodes if given."""
    found = facts.groupBy("namespace").agg(
        F.count_if(F.col("is_latest") == 1).alias("facts_latest"),
        F.count_if(F.col("is_latest") == 0).alias("facts_retired"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("chains"),
    )
    for name, rows in (("entities", entities), ("episodes", episodes)):
        if rows is not None:
            found = found.join(rows.groupBy("namespace").agg(F.count(F.lit(1)).alias(name)), "namespace", "full_outer")
    return found.na.fill(0, [c for c in found.columns if c != "namespace"])


def ranked(over: DataFrame) -> DataFrame:
    """Namespaces with the most facts first, ties by name."""
    return over.orderBy(F.desc(F.col("facts_latest") + F.col("facts_retired")), "namespace")


def facts_per_add(over: DataFrame, adds: DataFrame) -> DataFrame:
    """Facts for each add (namespace, adds), rounded to tenths; null where there was none."""
    total = F.col("facts_latest") + F.col("facts_retired")
    return over.join(adds.select("namespace", "adds"), "namespace", "left").withColumn("facts_per_add", total / F.nullif(F.col("adds"), F.lit(0)))


def supersession_rate(over: DataFrame) -> DataFrame:
    total = F.col("facts_latest") + F.col("facts_retired")
    return over.withColumn("supersession_rate", F.coalesce(F.col("facts_retired") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def top_predicates(facts: DataFrame, k: int = 5) -> DataFrame:
    counts = facts.groupBy("namespace", "predicate").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("namespace").orderBy(F.desc("n"), "predicate")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def entity_counts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Every entity with its number of facts; facts are counted before the join."""
    counts = facts.groupBy(F.col("subject_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return entities.join(counts, "id", "left").withColumn("fact_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def list_facts(
    facts: DataFrame, latest_only: bool = True, predicate: str | None = None, entity: str | None = None, min_salience: float | None = None,
    q: str | None = None, page: int = 1, page_size: int = 50, order: str = "created_at",
) -> tuple[DataFrame, DataFrame]:
    """A page of facts, newest first, and the count of all that match."""
    rows = facts.where("is_latest = 1") if latest_only else facts
    if predicate is not None:
        rows = rows.where(F.col("predicate") == predicate)
    if entity is not None:
        rows = rows.where(F.lower("subject_name") == entity.lower())
    if min_salience is not None:
        rows = rows.where(F.col("salience") >= min_salience)
    if q is not None:
        terms = query_terms(q)
        rows = rows.where(F.arrays_overlap(search_tokens(F.col("fact_text")), F.array(*map(F.lit, terms))) if terms else F.lit(False))
    size = min(max(page_size, 1), 200)
    paged = rows.orderBy(F.desc(order), F.desc("id")).offset((max(page, 1) - 1) * size).limit(size)
    return paged, rows.agg(F.count(F.lit(1)).alias("total"))


def activity(events: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Adds and searches of the last days by namespace, without those of the console itself; the first event of all."""
    recent = (F.col("ts") >= now - days * 86_400_000) & F.coalesce(F.get_json_object("payload", "$.origin") != "ui", F.lit(True))
    return events.groupBy("namespace").agg(
        F.count_if(recent & (F.col("kind") == "add")).alias("adds"), F.count_if(recent & (F.col("kind") == "search")).alias("searches"), F.min("ts").alias("earliest_ts")
    )


def list_events(events: DataFrame, namespace, kind: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of a namespace's events, newest first."""
    rows = events.where(F.col("namespace") == namespace)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    size = min(max(page_size, 1), 200)
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset((max(page, 1) - 1) * size).limit(size)


def open_namespaces(rows: DataFrame) -> DataFrame:
    """Namespaces that rows name, without reserved ones."""
    return rows.select("namespace").distinct().where(~F.startswith("namespace", F.lit("_")))


def retained(events: DataFrame, keep: int = 10_000) -> DataFrame:
    """The newest events of each namespace."""
    newest = W.partitionBy("namespace").orderBy(F.desc("ts"), F.desc("id"))
    return events.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def known_entities(entities: DataFrame, keep: int = 100) -> DataFrame:
    """The newest names of each namespace, as context for routing and typing."""
    newest = W.partitionBy("namespace").orderBy(F.desc("created_at"), F.desc("id"))
    return entities.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")

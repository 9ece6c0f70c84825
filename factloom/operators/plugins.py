"""Where models plug in: each is a protocol with a deterministic stand-in elsewhere in this package, and runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import entity_key


class Generator(Protocol):
    """Finds candidates in texts: a row (subject_name, predicate, object_literal, confidence, start, end) for each."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, str, float, int, int]]]: ...


class Typer(Protocol):
    """Relations of candidates: asserts, supersedes, extends or derives."""

    def __call__(self, sentences: list[str]) -> list[str]: ...


class Summarizer(Protocol):
    backend_id: str

    def __call__(self, texts: list[list[str]]) -> list[str]: ...


class Judge(Protocol):
    def __call__(self, gold: list[str], hypotheses: list[str]) -> list[bool]: ...


@dataclass(frozen=True)
class Strategies:
    """What an engine runs at each step; a step that isn't given is the deterministic one.

    generate, route and typed take and give DataFrames (see operators.extract); adjudicate labels (new, old) objects of
    the middle band; rerank scores (query, texts); summarize makes one text of each list of texts.
    """

    generate: Callable[[DataFrame], DataFrame] | None = None
    route: Callable[[DataFrame], DataFrame] | None = None
    typed: Callable[[DataFrame], DataFrame] | None = None
    adjudicate: Callable[[str, str], str] | None = None
    rerank: Callable[[str, list[str]], list[float]] | None = None
    summarize: Summarizer | None = None


def summarized_by(found: DataFrame, facts: DataFrame, model: Summarizer) -> DataFrame:
    """Summaries (subject_id, source_fact_ids, ...) with a model's texts of their sources, in the order of the ids."""
    sources = found.select("subject_id", F.posexplode("source_fact_ids").alias("_at", "id")).join(facts.select("id", "fact_text"), "id")
    texts = sources.groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "fact_text"))), lambda x: x["fact_text"]).alias("_texts"))

    @F.pandas_udf(T.StringType())
    def said(lists: pd.Series) -> pd.Series:
        return pd.Series(model([list(x) for x in lists]), dtype=object)

    return found.drop("summary_text").join(texts, "subject_id").withColumn("summary_text", said("_texts")).drop("_texts")


def judged_by(rows: DataFrame, judge: Judge, gold: str = "gold", hypothesis: str = "hypothesis", into: str = "label") -> DataFrame:
    """Rows with a judge's verdicts, in batches."""

    @F.pandas_udf(T.BooleanType())
    def verdicts(golds: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series(judge(golds.tolist(), said.tolist()), dtype=object)

    return rows.withColumn(into, verdicts(gold, hypothesis))


def combined(relations: DataFrame, entities: DataFrame, on: list[str]) -> DataFrame:
    """Relations (on, subject_name, object_literal, confidence) that entities (on, name, confidence) ground: a relation is
    as sure as the least sure of itself and its two ends; an end that no entity names doesn't count."""
    sure = entities.groupBy(*on, "name").agg(F.max("confidence").alias("_c"))
    for end in ("subject_name", "object_literal"):
        relations = relations.join(sure.withColumnsRenamed({"name": end, "_c": f"_{end}"}), [*on, end], "left")
    least = F.least("confidence", F.coalesce("_subject_name", F.lit(1.0)), F.coalesce("_object_literal", F.lit(1.0)))
    return relations.withColumns({"confidence": least, "grounded": F.col("_subject_name").isNotNull()}).drop("_subject_name", "_object_literal")


def canonical(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates whose subjects are spelled as the namespace's entity of the same key (namespace, name_key, name)."""
    known = entities.groupBy("namespace", "name_key").agg(F.min("name").alias("_name"))
    keyed = candidates.withColumn("name_key", entity_key(F.col("subject_name"))).join(known, ["namespace", "name_key"], "left")
    return keyed.withColumn("subject_name", F.coalesce("_name", "subject_name")).drop("_name", "name_key")


def widened(raw: Column, start: Column, end: Column) -> Column:
    """The sentence around a span: from behind the last full stop before it to the first one after it."""
    before = F.substring(raw, F.lit(1), start)
    head = F.length(before) - F.length(F.substring_index(before, ".", -1))
    after = F.substring(raw, end + 1, F.length(raw))
    tail = F.length(F.substring_index(after, ".", 1))
    return F.trim(F.substring(raw, head + 1, end + tail - head))


def generate(episodes: DataFrame, make: Callable[[], Generator], threshold: float = 0.4, raw: str = "raw") -> DataFrame:
    """Candidates of a model, made once a task; those under the threshold go, and spans are widened to sentences."""
    schema = T.StructType(
        [*episodes.schema.fields]
        + [T.StructField(n, T.StringType()) for n in ("subject_name", "predicate", "object_literal")]
        + [T.StructField("confidence", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
    names = [f.name for f in schema.fields[len(episodes.columns) :]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            found = model(batch[raw].fillna("").tolist())
            rows = batch.loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
            yield pd.concat([rows, pd.DataFrame([c for f in found for c in f], columns=names)], axis=1)

    found = episodes.mapInPandas(run, schema).where(F.col("confidence") >= threshold)
    return found.withColumn("sentence", widened(F.col(raw), F.col("start"), F.col("end")))


def typed_by(candidates: DataFrame, typer: Typer, fallback: Column, least_confidence: float = 0.75) -> DataFrame:
    """A model's relations; where it fails, those of the fallback. Typed candidates have at least this confidence."""

    @F.pandas_udf(T.StringType())
    def relations(sentences: pd.Series) -> pd.Series:
        try:
            return pd.Series(typer(sentences.tolist()), dtype=object)
        except Exception:  # the contract of a model that is away: the whole batch falls back
            return pd.Series([None] * len(sentences), dtype=object)

    rows = candidates.withColumn("_relation", relations("sentence"))
    return rows.withColumns(
        {"relation": F.coalesce("_relation", fallback), "confidence": F.when(F.col("_relation").isNotNull(), F.greatest("confidence", F.lit(least_confidence))).otherwise(F.col("confidence"))}
    ).drop("_relation")

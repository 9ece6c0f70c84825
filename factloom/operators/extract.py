"""From episodes to typed candidates, with column expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as X


def split_sentences(episodes: DataFrame, raw: str = "raw") -> DataFrame:
    """A row for each sentence, with its place `pos` from 0; other columns stay."""
    return episodes.select("*", F.posexplode(X.sentences(F.coalesce(F.col(raw), F.lit("")))).alias("pos", "sentence"))


def candidates(episodes: DataFrame, raw: str = "raw") -> DataFrame:
    """One candidate a sentence that has a relation verb and an object; columns of the episode stay."""
    rows = split_sentences(episodes, raw).withColumn("predicate", X.relation(F.col("sentence"))).where("predicate IS NOT NULL")
    rows = rows.withColumns({"first_person": X.first_person(F.col("sentence")), "verb_end": X.verb_end(F.col("sentence"), F.col("predicate"))})
    rows = rows.withColumn("subject", X.subject(F.col("sentence"), F.col("first_person")))
    rows = rows.withColumn("object_literal", X.object_after(F.col("sentence"), F.greatest(F.col("subject.end"), F.col("verb_end"))))
    return rows.where("object_literal IS NOT NULL").withColumns(
        {
            "subject_name": F.col("subject.name"),
            "grounded": F.col("subject.grounded"),
            "confidence": X.confidence(F.col("first_person"), F.col("predicate")),
        }
    ).drop("subject", "verb_end")


def rules_candidates(episodes: DataFrame, raw: str = "raw", t_ref: str = "t_ref", default: str = "user") -> DataFrame:
    """The older extractor: a candidate for each sentence with one of its verbs, of confidence 0.6 and without an object.

    The subject is the speaker, else the first word that starts with a capital, else the first word. A date in the
    sentence (year-month-day) is when it holds, at the episode's time of day; else the episode's own time is.
    """
    rows = split_sentences(episodes, raw)
    s = F.col("sentence")
    predicate = F.coalesce(*[F.when(X.has_word(s, pattern), F.lit(name)) for name, pattern in X.RULE_VERBS])
    rows = rows.withColumn("predicate", predicate).where("predicate IS NOT NULL")
    words = F.transform(F.split(X.strip_spaces(s), rf"{X.SPACE}+", -1), lambda w: F.regexp_replace(w, rf"^{X.EDGE_CLASS}+|{X.EDGE_CLASS}+$", ""))
    lead = F.coalesce(F.get(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")), F.lit(0)), F.get(words, F.lit(0)))
    day = F.regexp_extract(s, rf"{X.BEFORE}(\d{{4}}-\d{{2}}-\d{{2}}){X.AFTER}", 1)
    at = F.unix_date(F.try_to_date(F.nullif(day, F.lit("")))).cast("long") * 86_400_000 + F.pmod(F.col(t_ref), F.lit(86_400_000))
    return rows.withColumns(
        {
            "subject_name": F.when(X.has_word(s, X.RULE_FIRST_PERSON), F.lit(default)).otherwise(lead),
            "fact_text": X.strip_spaces(s),
            "valid_at": F.coalesce(at, F.col(t_ref)),
            "confidence": F.lit(0.6),
        }
    )


def route(found: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Add `reasons` and `escalated`."""
    reasons = X.router_reasons(
        F.col("sentence"), F.col("subject_name"), F.col("object_literal"), F.col("predicate"), F.col("confidence"), F.col("grounded"), threshold=threshold
    )
    return found.withColumn("reasons", reasons).withColumn("escalated", F.size("reasons") > 0)


def typed(routed: DataFrame) -> DataFrame:
    """Add the relation, is_inference and the salience of a fact as ingested."""
    relation = X.typed_relation(F.col("sentence"))
    rows = routed.withColumn("relation", relation).withColumn("is_inference", (F.col("relation") == "derives").cast("int"))
    return rows.withColumn("salience", X.salience(F.col("sentence"), F.lit(False), F.col("is_inference") == 1))


def router_stats(routed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """seen, escalated and rate, and a count for each reason, as one aggregation."""
    reason = lambda r: F.count_if(F.array_contains("reasons", r)).alias(f"n_{r}")
    return routed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if("escalated").alias("escalated"),
        *[reason(r) for r in ("pre_flagged", "low_confidence", "coreference", "derives")],
    ).withColumn("rate", F.coalesce(F.col("escalated") / F.nullif(F.col("seen"), F.lit(0)), F.lit(0.0)))


def resolve_entities(mentions: DataFrame, namespace: str = "namespace", name: str = "subject_name", seq: str = "seq") -> DataFrame:
    """One entity a (namespace, folded name): the oldest mention's spelling, and an id made from the key."""
    keyed = mentions.withColumn("name_key", X.entity_key(F.col(name)))
    return keyed.groupBy(namespace, "name_key").agg(F.min_by(name, seq).alias("name"), F.min(seq).alias("first_seq")).withColumn(
        "entity_id", F.substring(F.sha2(F.concat_ws("\u0001", F.col(namespace).cast("string"), "name_key"), 256), 1, 16)
    )

"""The given tables as episodes and facts, in Spark and, under the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.spine import intervals

#: The first turn's time, and "now" for queries over events: 2024-03-01.
T0 = 1_700_000_000_000
NOW = 1_709_251_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever zone the session has."""
    return F.expr(f"CAST(CAST(CAST({ts} - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(18, 3)) * 1000 AS BIGINT)")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations`: a namespace each, a turn a second."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").alias("namespace"), F.col("turn").alias("seq"), F.col("role").alias("source"), F.coalesce("text", F.lit("")).alias("raw"), (F.lit(T0) + F.col("turn") * 1000).alias("t_ref")
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as facts of functional slots (user, kind of event)."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).alias("namespace"),
        F.col("user_id").cast("string").alias("subject_id"),
        F.col("event_type").alias("predicate"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("fact_text"),
        epoch_ms("ts").alias("valid_at"),
        ((F.col("event_id") % 100) / 10.0).alias("salience"),
        (F.col("event_id") % 7).alias("access_count"),
        F.when(F.col("event_id") % 3 == 0, epoch_ms("ts") + 3_600_000).alias("last_access"),
        F.when(F.col("event_id") % 5 == 0, "cold").otherwise("hot").alias("tier"),
        F.when(F.col("event_id") % 50 == 0, "summary").otherwise("fact").alias("record_kind"),
    )
    return intervals(rows, ["subject_id", "predicate"])


EPISODES = f"""ep AS (SELECT conv_id AS namespace, turn AS seq, role AS source, coalesce(text, '') AS raw, {T0} + turn * 1000 AS t_ref FROM conversations)"""
EVENTS = """ev AS (
  SELECT *, lead(valid_at) OVER w AS valid_to, lead(id) OVER w AS superseded_by, (lead(id) OVER w IS NULL)::INT AS is_latest
  FROM (
    SELECT event_id AS id, user_id % 10 AS namespace, user_id::VARCHAR AS subject_id, event_type AS predicate,
      concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS fact_text, epoch_ms(ts) AS valid_at,
      ((event_id % 100) / 10.0)::DOUBLE AS salience, event_id % 7 AS access_count,
      CASE WHEN event_id % 3 = 0 THEN epoch_ms(ts) + 3600000 END AS last_access,
      CASE WHEN event_id % 5 = 0 THEN 'cold' ELSE 'hot' END AS tier, CASE WHEN event_id % 50 = 0 THEN 'summary' ELSE 'fact' END AS record_kind
    FROM events)
  WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY valid_at, id))"""
#: Sentences in SQL: marks the seams, as RE2 has no lookbehind.
SENTENCES = f"""{EPISODES},
sp AS (
  SELECT namespace, seq, source, t_ref, unnest(ss) AS sentence, unnest(range(len(ss))) AS pos
  FROM (SELECT *, list_filter(string_split(regexp_replace(trim(raw, E' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \\n\\t\\r') <> '') AS ss FROM ep))"""

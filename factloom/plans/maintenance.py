"""Queries of maintenance and of the proposal lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.operators import lifecycle, maintain
from factloom.plans.inputs import EVENTS, NOW, epoch_ms, event_facts, table
from factloom.plans.text import NORMAL

DAY = 86_400_000
#: All event facts count as current here, so that slots hold many; "now" leaves most of them old.
LATER = NOW + 100 * DAY
#: The last run's cursor: 2024-01-16.
SINCE = 1_705_363_200_000
CONFIG = maintain.Config(min_cluster=5, evict_threshold=0.35, auto_salience=3.0, auto_age_days=120)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_facts(spark, sf_dir).withColumn("is_latest", F.lit(1)).withColumn("tier", F.lit("hot"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("subject_id"), F.col("lang").alias("predicate"), F.col("text").alias("fact_text"), (F.col("doc_id") % 97).alias("valid_at"),
        F.lit(None).cast("long").alias("last_access"), (F.col("doc_id") % 5).alias("access_count"), F.lit(1).alias("is_latest"), F.lit("fact").alias("record_kind"),
    )


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintain.dedup_exact(_documents(spark, sf_dir))
    return found.select("subject_id", "predicate", "survivor_id", F.array_join("loser_ids", ",").alias("loser_ids"), "merged_access_count", "merged_last_access")


def usage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among event facts, as the events that merging them appends."""
    return lifecycle.merge_events(maintain.dedup_exact(_facts(spark, sf_dir)), NOW).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("val").cast("long")), F.lit(0)).alias("total"))


def dedup_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 13).alias("valid_at"))
    # halves of the product, as in SQL: F.round takes them from the decimal digits, so 0.33795 would become 0.338
    cosine = F.round(F.col("cosine") * 10_000) / 10_000
    return maintain.near_pairs(rows, 0.3, slot=["label"], text=None).select(F.col("slot").cast("int").alias("label"), "a", "b", cosine.alias("cosine"))


def summarize_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintain.summarize(_facts(spark, sf_dir), LATER, CONFIG)
    return found.select("subject_id", F.round("heat", 6).alias("heat"), F.array_join("source_fact_ids", ",").alias("sources"), "summary_text")


def subject_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = scoring.standing_value(F.col("salience"), F.col("last_access"), F.col("valid_at"), F.col("access_count"), LATER)
    return maintain.live(_facts(spark, sf_dir)).groupBy("subject_id").agg(F.round(F.sum(value), 6).alias("heat"))


def evict_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = scoring.standing_value(F.col("salience"), F.col("last_access"), F.col("valid_at"), F.col("access_count"), LATER)
    return _facts(spark, sf_dir).select("id", F.round(value, 8).alias("value"))


def evict_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.evict_auto(_facts(spark, sf_dir), LATER, CONFIG).select("id")


def evict_propose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.evict_propose(_facts(spark, sf_dir), LATER, CONFIG).select("id", F.round("value", 5).alias("value"))


def run_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = event_facts(spark, sf_dir).where(F.col("valid_at") > SINCE)
    return maintain.due(since, NOW - DAY, NOW).select("new_facts", F.round("new_salience", 4).alias("new_salience"), "due")


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("subject_id"), F.lit("evict").alias("kind"),
        epoch_ms("o_orderdate").alias("created_at"), (epoch_ms("o_orderdate") + 30 * DAY).alias("expires_at"),
    )


EARLY = 694_224_000_000  # 1992-01-01


def first_decision_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.status(_proposals(spark, sf_dir), _unique_decisions(spark, sf_dir), EARLY)
    return rows.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


def _unique_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of decisions with one number, the last dated and then the rejected one counts, so that the order is total."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    status = F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved")
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("proposal_id"), F.col("l_linenumber").cast("long").alias("seq")).agg(
        F.max(status).alias("status"), F.lit(None).cast("string").alias("reason"), F.max(epoch_ms("l_shipdate")).alias("decided_at"), F.max(epoch_ms("l_shipdate")).alias("applied_at")
    )


def proposal_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided proposals a while after the first ones: what silence has let expire."""
    none = _unique_decisions(spark, sf_dir).where("false")
    rows = lifecycle.status(_proposals(spark, sf_dir), none, MIDWAY)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("expires_at").alias("first_expiry"))


MIDWAY = 800_000_000_000


def review_queue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _proposals(spark, sf_dir).withColumn("status", F.lit("pending"))
    queue = lifecycle.review_queue(rows, 20)
    return queue.select("subject_id", F.col("first").cast("long").alias("first"), F.array_join(F.transform("proposals", lambda p: p["id"]), ",").alias("proposals"))


_FACTS = f"{EVENTS}, fa AS (SELECT * FROM ev WHERE record_kind <> 'summary')"
_VALUE = f"0.5 * salience / 10 + 0.3 * exp(-greatest(0, {LATER} - coalesce(nullif(last_access, 0), valid_at))::DOUBLE / {30 * DAY}) + 0.2 * least(1, ln(1 + access_count) / ln(11))"
_GUARDS = f"record_kind <> 'summary' AND salience < 6 AND {LATER} - valid_at >= {90 * DAY}"
_AUTO = f"salience < 3 AND access_count = 0 AND {LATER} - valid_at > {120 * DAY}"
_PROPOSALS = f"pr AS (SELECT o_orderkey AS id, o_custkey AS subject_id, epoch_ms(o_orderdate) AS created_at, epoch_ms(o_orderdate) + {30 * DAY} AS expires_at FROM orders)"
QUERIES = {
    f.__name__: f
    for f in (
        dedup_exact, usage_merge, dedup_near, summarize_candidates, subject_heat, evict_value, evict_auto, evict_propose, run_thresholds, first_decision_wins, proposal_expiry,
        review_queue_groups,
    )
}
ORACLES = {
    "dedup_exact": f"""
WITH d AS (SELECT doc_id, source, lang, {NORMAL.format('text')} AS norm, doc_id % 97 AS valid_at, doc_id % 5 AS access_count FROM documents),
g AS (SELECT source, lang, list(doc_id ORDER BY valid_at, doc_id) AS ids, sum(access_count)::BIGINT AS merged_access_count, max(valid_at) AS merged_last_access FROM d GROUP BY source, lang, norm HAVING count(*) > 1)
SELECT source AS subject_id, lang AS predicate, ids[1] AS survivor_id, array_to_string(list_sort(ids[2:]), ',') AS loser_ids, merged_access_count, merged_last_access FROM g""",
    "usage_merge": f"""WITH {_FACTS},
g AS (SELECT count(*) AS n, sum(access_count)::BIGINT AS total FROM fa GROUP BY subject_id, predicate, {NORMAL.format('fact_text')} HAVING count(*) > 1)
SELECT 'retire_duplicate' AS kind, sum(n - 1)::BIGINT AS n, 0::BIGINT AS total FROM g UNION ALL SELECT 'usage_merge', count(*), sum(total)::BIGINT FROM g""",
    "dedup_near": """
WITH v AS (SELECT vec_id AS id, label, vec_id % 13 AS valid_at, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.label, a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine
  FROM v a JOIN v b ON a.label = b.label AND (a.valid_at < b.valid_at OR a.valid_at = b.valid_at AND a.id < b.id))
SELECT label, a, b, round(cosine, 4) AS cosine FROM p WHERE cosine >= 0.3""",
    "summarize_candidates": f"""WITH {_FACTS},
o AS (SELECT *, {_VALUE} AS value, count(*) OVER (PARTITION BY subject_id, predicate) AS size FROM fa WHERE {LATER} - valid_at >= {90 * DAY}),
h AS (SELECT subject_id, sum(value) AS heat FROM o GROUP BY subject_id),
s AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY salience DESC, id) AS rank FROM o WHERE size >= 5)
SELECT subject_id, round(any_value(heat), 6) AS heat, string_agg(id::VARCHAR, ',' ORDER BY valid_at, id) AS sources,
  rtrim('Summary (extractive): ' || string_agg(CASE WHEN rank <= 5 THEN trim(fact_text) END, ' ' ORDER BY rank)) AS summary_text
FROM s JOIN h USING (subject_id) GROUP BY subject_id""",
    "subject_heat": f"WITH {_FACTS} SELECT subject_id, round(sum({_VALUE}), 6) AS heat FROM fa GROUP BY subject_id",
    "evict_value": f"WITH {EVENTS} SELECT id, round({_VALUE}, 8) AS value FROM ev",
    "evict_auto": f"WITH {EVENTS} SELECT id FROM ev WHERE {_GUARDS} AND {_AUTO}",
    "evict_propose": f"WITH {EVENTS}, v AS (SELECT *, round({_VALUE}, 9) AS value FROM ev) SELECT id, round(value, 5) AS value FROM v WHERE {_GUARDS} AND NOT ({_AUTO}) AND value < 0.35",
    "run_thresholds": f"WITH {EVENTS} SELECT count(*) AS new_facts, round(sum(salience), 4) AS new_salience, count(*) >= 200 OR sum(salience) >= 300 AS due FROM ev WHERE valid_at > {SINCE}",
    "first_decision_wins": f"""WITH {_PROPOSALS},
de AS (SELECT l_orderkey AS id, l_linenumber AS seq, max(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END) AS status, max(epoch_ms(l_shipdate)) AS day FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
f AS (SELECT id, arg_min(status, seq) AS status, arg_min(day, seq) AS day FROM de GROUP BY id),
j AS (SELECT pr.id, CASE WHEN expires_at < coalesce(day, {EARLY}) THEN 'expired' ELSE coalesce(status, 'pending') END AS status, CASE WHEN expires_at < coalesce(day, {EARLY}) THEN 'timeout' END AS reason FROM pr LEFT JOIN f USING (id))
SELECT status, reason, count(*) AS n, sum(id)::BIGINT AS ids FROM j GROUP BY ALL""",
    "proposal_expiry": f"WITH {_PROPOSALS} SELECT CASE WHEN expires_at < {MIDWAY} THEN 'expired' ELSE 'pending' END AS status, count(*) AS n, min(expires_at) AS first_expiry FROM pr GROUP BY 1",
    "review_queue_groups": f"""WITH {_PROPOSALS},
n AS (SELECT id::VARCHAR AS id, subject_id, row_number() OVER (ORDER BY created_at DESC, id::VARCHAR DESC) AS place FROM pr QUALIFY place <= 20)
SELECT subject_id, min(place) AS first, string_agg(id, ',' ORDER BY place) AS proposals FROM n GROUP BY subject_id""",
}

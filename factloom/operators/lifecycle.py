"""Runs and proposals as appended logs: the first decision on a proposal wins, silence expires, stale targets are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The payload of each kind of proposal.
PAYLOADS = {
    "dedup_near": "slot struct<subject_id:string,predicate:string>, fact_ids array<string>, fact_texts map<string,string>, cosine double, multivalued boolean, proposed_survivor string, evidence_backend string",
    "summarize": "subject_id string, source_fact_ids array<string>, source_fact_texts map<string,string>, summary_text string, evidence_backend string",
    "evict": "fact_id string, fact_text string, value double, salience double, access_count long, evidence_backend string",
}


def status(proposals: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """Each proposal with its status: of decisions the first (by seq) holds, and only if made before the expiry."""
    first = decisions.groupBy("proposal_id").agg(F.min_by(F.struct("status", "reason", "decided_at", "applied_at"), "seq").alias("d"))
    rows = proposals.join(first, proposals["id"] == first["proposal_id"], "left").drop("proposal_id")
    late = F.col("expires_at") < F.coalesce("d.decided_at", F.lit(now))
    return rows.withColumns(
        {
            "status": F.when(late, "expired").otherwise(F.coalesce("d.status", F.lit("pending"))),
            "reason": F.when(late, "timeout").otherwise(F.col("d.reason")),
            "applied_at": F.when(~late, F.col("d.applied_at")),
        }
    ).drop("d")


def review_queue(proposals: DataFrame, limit: int = 20, subject: str = "subject_id") -> DataFrame:
    """Pending proposals, newest first, at most `limit`, grouped by subject in the order of their first one."""
    newest = proposals.where("status = 'pending'").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    placed = newest.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("id"))))
    grouped = placed.groupBy(subject).agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "id", "kind"))).alias("proposals"))
    return grouped.orderBy("first")


def signatures(proposals: DataFrame, ids: str = "fact_ids") -> DataFrame:
    """An unordered signature of the facts each proposal names."""
    return proposals.withColumn("signature", F.array_join(F.array_sort(F.array_distinct(ids)), "\u0001"))


def not_pending(found: DataFrame, pending: DataFrame, ids: str = "fact_ids", pending_ids: str | None = None) -> DataFrame:
    """Proposals whose facts aren't those of a pending one."""
    return signatures(found, ids).join(signatures(pending, pending_ids or ids).select("signature").distinct(), "signature", "left_anti").drop("signature")


def valid_merges(merges: DataFrame, facts: DataFrame) -> DataFrame:
    """Approved merges (a, b) with `ok`: both still latest and open, and in one slot."""
    live = facts.where("is_latest = 1 AND valid_to IS NULL").select("id", "subject_id", "predicate")
    a, b = live.select(F.col("id").alias("a"), F.struct("subject_id", "predicate").alias("slot_a")), live.select(F.col("id").alias("b"), F.struct("subject_id", "predicate").alias("slot_b"))
    return merges.join(a, "a", "left").join(b, "b", "left").withColumn("ok", F.coalesce(F.col("slot_a") == F.col("slot_b"), F.lit(False))).drop("slot_a", "slot_b")


def canonical_merges(merges: DataFrame, facts: DataFrame) -> DataFrame:
    """Merges whose survivors are live: a retired survivor stands for the fact it points at, one step on. A merge that
    then has no other loser goes."""
    on = facts.where("is_latest = 0 AND superseded_by IS NOT NULL").select(F.col("id").alias("survivor_id"), F.col("superseded_by").alias("_on"))
    moved = merges.join(on, "survivor_id", "left").withColumn("survivor_id", F.coalesce("_on", "survivor_id")).drop("_on")
    return moved.withColumn("loser_ids", F.array_remove("loser_ids", F.col("survivor_id"))).where(F.size("loser_ids") > 0)


def repoint_events(merges: DataFrame, facts: DataFrame, now: int) -> DataFrame:
    """Open duplicates that point at a loser point at its survivor from now on, so that each points at a live fact."""
    losers = merges.select(F.explode("loser_ids").alias("superseded_by"), F.col("survivor_id").alias("ref_id"))
    held = facts.where("is_latest = 0 AND valid_to IS NULL AND superseded_by IS NOT NULL").select("id", "superseded_by")
    return held.join(losers, "superseded_by").select(F.col("id").alias("fact_id"), F.lit("repoint").alias("kind"), F.lit(now).alias("at_ms"), "ref_id", F.lit(None).cast("string").alias("val"))


def merge_events(merges: DataFrame, now: int) -> DataFrame:
    """Exact merges (survivor_id, loser_ids, merged_access_count, merged_last_access) as events."""
    retire = merges.select(F.explode("loser_ids").alias("fact_id"), F.lit("retire_duplicate").alias("kind"), F.lit(now).alias("at_ms"), F.col("survivor_id").alias("ref_id"), F.lit(None).cast("string").alias("val"))
    usage = merges.select(F.col("survivor_id").alias("fact_id"), F.lit("usage_merge").alias("kind"), F.col("merged_last_access").alias("at_ms"), F.lit(None).cast("string").alias("ref_id"), F.col("merged_access_count").cast("string").alias("val"))
    return retire.unionByName(usage)


def tier_events(facts: DataFrame, tier: str, now: int) -> DataFrame:
    return facts.select(F.col("id").alias("fact_id"), F.lit("tier").alias("kind"), F.lit(now).alias("at_ms"), F.lit(None).cast("string").alias("ref_id"), F.lit(tier).alias("val"))


def run_status(runs: DataFrame) -> DataFrame:
    """By namespace: runs, and the last one by its end or else its start."""
    last = F.struct(F.coalesce("finished_at", "started_at"), F.col("id"))
    return runs.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("runs"), F.max_by("id", last).alias("last_run"), F.max_by("status", last).alias("last_status"),
        F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_ok"),
    )


def stale(runs: DataFrame, now: int, days: int = 7) -> DataFrame:
    return run_status(runs).withColumn("is_stale", F.col("last_ok").isNull() | (F.lit(now) - F.col("last_ok") >= days * 86_400_000))

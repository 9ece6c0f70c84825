"""The append-only spine: visibility, current state from events, supersession chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.shared import materialized


def visible_at(valid_at: Column, valid_to: Column, t: int | Column) -> Column:
    """valid_at <= T and the half-open interval isn't closed by T."""
    at = F.lit(t) if isinstance(t, int) else t
    return (valid_at <= at) & (valid_to.isNull() | (valid_to > at))


def surface(facts: DataFrame, as_of: int | None = None, is_latest_only: bool = True, include_cold: bool = False) -> DataFrame:
    """The rows a search may see. The tier gate holds only for the default surface: latest, no as_of, no cold."""
    if as_of is not None:
        facts = facts.where(visible_at(F.col("valid_at"), F.col("valid_to"), as_of))
    if is_latest_only:
        facts = facts.where("is_latest = 1")
        if as_of is None and not include_cold:
            facts = facts.where("tier = 'hot'")
    return facts


def intervals(assertions: DataFrame, slot: list[str], at: str = "valid_at", tie: str = "id") -> DataFrame:
    """Facts of functional slots: each closes its predecessor at its own time."""
    by = W.partitionBy(*slot).orderBy(at, tie)
    return assertions.withColumns({"valid_to": F.lead(at).over(by), "superseded_by": F.lead(tie).over(by)}).withColumn(
        "is_latest", F.col("superseded_by").isNull().cast("int")
    )


def as_of_grid(facts: DataFrame, times: list[int], keys: list[str] | None = None) -> DataFrame:
    """How many facts are visible at each time (by keys): each fact is sent to the times its interval holds, from the
    given list alone, and counted before the shuffle."""
    grid = F.array(*[F.lit(t) for t in times]).cast("array<bigint>")
    inside = F.filter(grid, lambda t: visible_at(F.col("valid_at"), F.col("valid_to"), t))
    return facts.select(*(keys or []), F.explode(inside).alias("t")).groupBy(*(keys or []), "t").agg(F.count(F.lit(1)).alias("visible"))


def current(asserts: DataFrame, events: DataFrame) -> DataFrame:
    """The fact view: assertions with their events folded. Later events win; usage counts restart at a merge."""
    last = lambda value, kinds: F.max_by(F.when(F.col("kind").isin(*kinds), value), F.when(F.col("kind").isin(*kinds), F.col("seq")))
    # merges are few beside touches: their last one is told to the events before these are added up partially
    merges = events.where("kind = 'usage_merge'").groupBy(F.col("fact_id").alias("merged_id")).agg(F.max("seq").alias("merge_seq"))
    marked = events.join(merges, events["fact_id"] == merges["merged_id"], "left")
    folded = marked.groupBy("fact_id").agg(
        last(F.col("at_ms"), ("supersede", "cascade_close", "invalidate")).alias("valid_to"),
        last(F.col("ref_id"), ("supersede", "retire_duplicate", "repoint")).alias("superseded_by"),
        last(F.col("ref_id"), ("invalidate",)).alias("invalidated_by"),
        F.max(F.col("kind").isin("supersede", "retire_duplicate", "invalidate").cast("int")).alias("retired"),
        last(F.col("val"), ("tier",)).alias("tier"),
        last(F.col("val").cast("long"), ("usage_merge",)).alias("merged_count"),
        F.count_if((F.col("kind") == "touch") & (F.col("seq") > F.coalesce("merge_seq", F.lit(-1)))).alias("touches"),
        F.max(F.when(F.col("kind").isin("touch", "usage_merge"), F.col("at_ms"))).alias("last_access"),
    )
    return (
        asserts.join(folded, asserts["id"] == folded["fact_id"], "left")
        .withColumns(
            {
                "is_latest": F.when(F.coalesce("retired", F.lit(0)) == 0, 1).otherwise(0),
                "tier": F.coalesce("tier", F.lit("hot")),
                "access_count": F.coalesce("merged_count", F.lit(0)) + F.coalesce("touches", F.lit(0)),
            }
        )
        .drop("fact_id", "retired", "merged_count", "touches")
    )


def chains(facts: DataFrame, start: DataFrame) -> DataFrame:
    """All facts before and after the given ids along superseded_by: (start_id, id, step), older ones with steps below 0.

    Links are doubled: what lies up to 2**k steps away is joined with links of 2**k steps, until a round adds no row, so
    a chain of n steps takes log2(n) rounds and one more. Each direction holds a fact once, at its least distance, which
    also ends cycles.
    """
    links = facts.where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("to")).distinct()
    here = start.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("step")).distinct()
    found, begun = here, here.count()
    for sign, hops in ((1, links), (-1, links.select(F.col("to").alias("id"), F.col("id").alias("to")))):
        side, length, size = here, 1, begun
        while True:
            hops = materialized(hops, "links")
            if hops.isEmpty():
                break
            ahead = side.join(hops, "id").select("start_id", F.col("to").alias("id"), (F.col("step") + length).alias("step"))
            side = materialized(side.unionByName(ahead).groupBy("start_id", "id").agg(F.min("step").alias("step")), "chain")
            before, size = size, side.count()
            if size == before:
                break
            hops = hops.select("id", F.col("to").alias("via")).join(hops.select(F.col("id").alias("via"), "to"), "via").select("id", "to")
            length *= 2
        found = found.unionByName(side.where("step <> 0").withColumn("step", sign * F.col("step")))
    return found


def closing_events(closed: DataFrame, facts: DataFrame, derivations: DataFrame) -> DataFrame:
    """What a set of supersessions (fact_id, by_id, at_ms) entails: supersede events, the closing of open retired
    duplicates that point at a closed fact, and the invalidation of summaries that derive from any of these."""
    supersede = closed.select("fact_id", F.lit("supersede").alias("kind"), "at_ms", F.col("by_id").alias("ref_id"))
    duplicates = facts.where("is_latest = 0 AND valid_to IS NULL AND superseded_by IS NOT NULL").select(F.col("id").alias("dup"), F.col("superseded_by").alias("fact_id"))
    cascade = duplicates.join(closed, "fact_id").select(F.col("dup").alias("fact_id"), F.lit("cascade_close").alias("kind"), "at_ms", F.col("by_id").alias("ref_id"))
    gone = supersede.unionByName(cascade)
    summaries = derivations.join(gone.select(F.col("fact_id").alias("source_id"), "at_ms", "ref_id"), "source_id")
    stale = (
        summaries.join(facts.where("is_latest = 1").select(F.col("id").alias("summary_id")), "summary_id", "left_semi")
        .groupBy("summary_id")
        .agg(F.min("at_ms").alias("at_ms"), F.min("ref_id").alias("ref_id"))
        .select(F.col("summary_id").alias("fact_id"), F.lit("invalidate").alias("kind"), "at_ms", "ref_id")
    )
    return gone.unionByName(stale)

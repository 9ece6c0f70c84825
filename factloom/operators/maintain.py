"""Offline maintenance over the fact view: pure DataFrames; what they find becomes events or proposals.

Facts need: id, subject_id, predicate, fact_text, valid_at, last_access, access_count, salience, is_latest, record_kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.functions.text import MULTIVALUED, normalize_text
from factloom.operators.lifecycle import not_pending
from factloom.schema import MS_PER_DAY

SLOT = ["subject_id", "predicate"]
#: Facts of a slot that a task compares with each other, or with as many others.
BLOCK = 2048


@dataclass(frozen=True)
class Config:
    tau_near: float = 0.95
    age_floor_days: int = 90
    min_cluster: int = 5
    evict_threshold: float = 0.15
    auto_salience: float = 2.0
    auto_age_days: int = 180
    guard_salience: float = 6.0
    expiry_days: int = 30
    budget: int = 50
    min_new_facts: int = 200
    min_new_salience: float = 300.0
    max_age_days: int = 7
    summary_facts: int = 5


def live(facts: DataFrame) -> DataFrame:
    return facts.where("is_latest = 1 AND record_kind <> 'summary'")


def dedup_exact(facts: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Clusters of one slot and normalised text: survivor (least valid_at, id), losers, usage of all members.

    Adding up is partial; losers are gathered as ids alone.
    """
    rows = live(facts)
    if exclude is not None:
        rows = rows.join(exclude.select("id"), "id", "left_anti")
    rows = rows.withColumn("norm", normalize_text("fact_text"))
    seen = scoring.anchor(F.col("last_access"), F.col("valid_at"))
    found = rows.groupBy(*SLOT, "norm").agg(
        F.min_by("id", F.struct("valid_at", "id")).alias("survivor_id"),
        F.collect_list("id").alias("members"),
        F.sum("access_count").alias("merged_access_count"),
        F.max(seen).alias("merged_last_access"),
        F.count(F.lit(1)).alias("n"),
    )
    return found.where("n > 1").withColumn("loser_ids", F.array_sort(F.array_remove("members", F.col("survivor_id")))).drop("members")


def _dots(columns: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of vectors i and j, given by component, added up in the order of components: a matrix product's last
    bits depend on what else is in the block."""
    out = np.zeros(len(i))
    for c in columns:
        out += c[i] * c[j]
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves of x * 10**digits away from zero, as SQL rounds."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), x) / 10.0**digits


def near_pairs(facts: DataFrame, tau: float, slot: list[str] | None = None, embedding: str = "embedding", id: str = "id", text: str | None = "fact_text") -> DataFrame:
    """(slot..., a, b, cosine) with cosine >= tau and different normalised texts; a before b by (valid_at, id).

    A slot's facts go into blocks; a task compares two blocks by one matrix product, and only pairs found leave it. The
    cosine of what the product finds is computed again, rounded to 6 digits, and then compared with tau.
    """
    slot = slot or SLOT
    name = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in slot])
    rows = facts.where(F.col(embedding).isNotNull()).select(
        name.alias("slot"), F.col(id).alias("id"), "valid_at", F.col(embedding).cast("array<double>").alias("v"),
        (normalize_text(text) if text else F.col(id).cast("string")).alias("norm"),
    )
    # slots are counted without their vectors; only those of several blocks are joined back
    wide = rows.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    placed = rows.join(wide, "slot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    pairs = placed.withColumn("pair", F.explode(F.array_distinct(other)))
    kind = dict(rows.dtypes)["id"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["valid_at", "id"], ignore_index=True)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        columns = np.ascontiguousarray(v.T)
        size = np.sqrt(_dots(columns, np.arange(len(v)), np.arange(len(v))))
        unit = v / np.where(size == 0, 1, size)[:, None]
        block, norm, ids = pdf["block"].to_numpy(), pdf["norm"].to_numpy(), pdf["id"].to_numpy()
        one = block.min() == block.max() and pdf["pair"].iloc[0]["x"] == pdf["pair"].iloc[0]["y"]
        out = []
        for a in range(0, len(v), 512):
            i, j = np.nonzero(unit[a : a + 512] @ unit.T >= tau - 1e-6)  # half a millionth less can round to tau
            i += a
            fit = i < j
            i, j = i[fit], j[fit]
            fit = norm[i] != norm[j]
            if not one:
                fit &= block[i] != block[j]
            i, j = i[fit], j[fit]
            both = size[i] * size[j]
            cosine = _rounded(_dots(columns, i, j) / np.where(both == 0, 1, both), 6)
            fit = cosine >= tau
            out.append(pd.DataFrame({"slot": pdf["slot"].iloc[0], "a": ids[i[fit]], "b": ids[j[fit]], "cosine": cosine[fit]}))
        return pd.concat(out, ignore_index=True)

    return pairs.groupBy("slot", "pair").applyInPandas(compare, f"slot string, a {kind}, b {kind}, cosine double")


def summarize(facts: DataFrame, now: int, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Subjects with enough old facts in a slot: heat over all their old facts, sources, the extractive summary."""
    old = live(facts).where(F.lit(now) - F.col("valid_at") >= config.age_floor_days * MS_PER_DAY)
    value = scoring.standing_value(F.col("salience"), F.col("last_access"), F.col("valid_at"), F.col("access_count"), now)
    slots = old.groupBy(*SLOT).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("heat"), F.collect_list(F.struct("valid_at", "id", "salience", "fact_text")).alias("facts")
    )
    enough = F.col("n") >= config.min_cluster
    by_subject = slots.groupBy("subject_id").agg(
        F.sum("heat").alias("heat"), F.count_if(enough).alias("slots"), F.flatten(F.collect_list(F.when(enough, F.col("facts")))).alias("facts")
    )
    found = by_subject.where("slots > 0")
    sources = F.transform(F.array_sort(F.transform("facts", lambda f: F.struct(f["valid_at"], f["id"]))), lambda f: f["id"])
    best = F.slice(F.array_sort(F.transform("facts", lambda f: F.struct((-f["salience"]).alias("s"), f["id"].alias("id"), f["fact_text"].alias("t")))), 1, config.summary_facts)
    text = F.rtrim(F.concat(F.lit("Summary (extractive): "), F.array_join(F.transform(best, lambda f: F.trim(f["t"])), " ")))
    return found.select("subject_id", F.round("heat", 9).alias("heat"), sources.alias("source_fact_ids"), text.alias("summary_text"))


def guarded(now: int, config: Config = Config()) -> Column:  # noqa: B008
    """Facts that eviction may look at: no summaries, nothing salient, nothing young."""
    return (F.col("record_kind") != "summary") & (F.col("salience") < config.guard_salience) & (F.lit(now) - F.col("valid_at") >= config.age_floor_days * MS_PER_DAY)


def auto_band(now: int, config: Config = Config()) -> Column:  # noqa: B008
    return (F.col("salience") < config.auto_salience) & (F.col("access_count") == 0) & (F.lit(now) - F.col("valid_at") > config.auto_age_days * MS_PER_DAY)


def evict_auto(facts: DataFrame, now: int, config: Config = Config()) -> DataFrame:  # noqa: B008
    return facts.where("is_latest = 1 AND tier = 'hot'").where(guarded(now, config) & auto_band(now, config))


def evict_propose(facts: DataFrame, now: int, config: Config = Config()) -> DataFrame:  # noqa: B008
    value = scoring.standing_value(F.col("salience"), F.col("last_access"), F.col("valid_at"), F.col("access_count"), now)
    rows = facts.where("is_latest = 1 AND tier = 'hot'").where(guarded(now, config) & ~auto_band(now, config))
    return rows.withColumn("value", F.round(value, 9)).where(F.col("value") < config.evict_threshold)


def transforms(facts: DataFrame, now: int, config: Config = Config(), pending: DataFrame | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """One run over a snapshot: proposals first, under one budget (near, summarize, evict), then what applies by itself,
    without any fact that a proposal names. The budget bounds what is counted here.

    `pending` (kind, ids) holds what earlier runs proposed and nobody has decided: the same evidence isn't proposed again.
    """
    multivalued = F.element_at(F.split("slot", "\u0001"), -1).isin(*MULTIVALUED)
    near = near_pairs(live(facts), config.tau_near).withColumns({"multivalued": multivalued, "fact_ids": F.array("a", "b")})
    summaries = summarize(facts, now, config)
    evictions = evict_propose(facts, now, config)
    waiting = None
    if pending is not None:
        near = not_pending(near, pending.where("kind = 'dedup_near'"), "fact_ids", "ids")
        summaries = not_pending(summaries, pending.where("kind = 'summarize'"), "source_fact_ids", "ids")
        waiting = pending.select(F.explode("ids").alias("id")).distinct()
        evictions = evictions.join(waiting, "id", "left_anti")
    all_found = {"near": near, "summaries": summaries, "evictions": evictions}
    near = near.orderBy("slot", "a", "b").limit(config.budget)
    left = config.budget - near.count()
    summaries = summaries.orderBy(F.desc("heat"), "subject_id").limit(left)
    left -= summaries.count()
    evictions = evictions.orderBy("value", "id").limit(left)
    named = near.select(F.explode("fact_ids").alias("id")).unionByName(summaries.select(F.explode("source_fact_ids").alias("id"))).unionByName(evictions.select("id"))
    if waiting is not None:
        named = named.unionByName(waiting)
    named = named.distinct()
    return {
        "dedup_near": near,
        "summarize": summaries,
        "evict": evictions,
        "merges": dedup_exact(facts, named),
        "demotions": evict_auto(facts, now, config).join(named, "id", "left_anti"),
        "found": all_found["near"].select(F.lit("dedup_near").alias("kind")).unionByName(all_found["summaries"].select(F.lit("summarize").alias("kind"))).unionByName(all_found["evictions"].select(F.lit("evict").alias("kind"))),
    }


def due(facts_since: DataFrame, last_finished: int | None, now: int, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Whether a run is due: enough new facts or salience, or the last run is too old; the first run always is."""
    stats = facts_since.agg(F.count(F.lit(1)).alias("new_facts"), F.coalesce(F.sum("salience"), F.lit(0.0)).alias("new_salience"))
    old = F.lit(last_finished is None or now - (last_finished or 0) >= config.max_age_days * MS_PER_DAY)
    return stats.withColumn("due", (F.col("new_facts") >= config.min_new_facts) | (F.col("new_salience") >= config.min_new_salience) | old)

"""The facade: add episodes, search, maintain, review and decide, over a store of appended batches.

`add_batch` takes any number of episodes of any number of namespaces in one pass; `add` is the same for one.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.embed import Embedder, FakeEmbedder
from factloom.functions.vectors import truncate
from factloom.operators import extract, inspect, lifecycle, maintain, resolve, retrieve, spine
from factloom.operators.plugins import Strategies, summarized_by
from factloom.schema import MS_PER_DAY
from factloom.shared import materialized
from factloom.sources.store import BATCH, Store

SLOT = ["namespace", "subject_id", "predicate"]


def now_ms() -> int:
    return int(time.time() * 1000)


def _hash(*parts: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), 1, 16)


class Memory:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: maintain.Config | None = None, strategies: Strategies | None = None, store: Store | None = None):
        self.spark, self.store = spark, store or Store(spark, root)
        self.strategies = strategies or Strategies()
        self.embedder, self.config = embedder or FakeEmbedder(64, 16), config or maintain.Config()

    # ── ingest ──
    def add(self, namespace: str, text: str, t_ref: int | None = None, source: str = "user") -> list[str]:
        """Ingest one message; the ids of the facts written."""
        row = [(namespace, text, now_ms() if t_ref is None else t_ref, source)]
        batch = self.add_batch(self.spark.createDataFrame(row, "namespace string, raw string, t_ref long, source string"))
        return [r["id"] for r in batch.select("id").orderBy("seq").collect()]

    def add_batch(self, episodes: DataFrame, mark: str | None = None) -> DataFrame:
        """Ingest episodes (namespace, raw, t_ref, source) in order of t_ref, then of `arrival` where that is a column;
        the facts written. All of it is one unit of work; one whose mark is in the store already writes nothing."""
        with self.store.unit(mark) as fresh:
            if not fresh:
                return self.spark.createDataFrame([], self.store.read("fact_assert").schema)
            base = self.store.next_batch() * BATCH
            arrival = F.col("arrival").cast("long") if "arrival" in episodes.columns else F.lit(0).cast("long")
            rows = episodes.select("namespace", "raw", "t_ref", "source", arrival.alias("arrival"))
            rows = rows.withColumn("id", _hash("namespace", "t_ref", "source", "raw", "arrival", F.lit(str(base))))
            rows = materialized(rows, "episodes")
            self.store.append("episode", rows.withColumns({"created_at": F.col("t_ref"), "seq": F.lit(base)}))
            steps = self.strategies
            made = (steps.generate or extract.candidates)(rows.select("namespace", F.col("id").alias("episode_id"), "raw", "t_ref", "arrival"))
            found = (steps.typed or extract.typed)((steps.route or extract.route)(made))
            found = found.withColumn("predicate", X.predicate_or_default(F.col("predicate"))).withColumn("name_key", X.entity_key("subject_name")).withColumn("subject_id", _hash("namespace", "name_key"))
            order = F.struct("t_ref", "arrival", "episode_id", (~F.col("escalated")).alias("direct"), "pos")
            slot_order = F.row_number().over(_window(SLOT, order))
            facts = found.select(
                F.concat(F.lpad(F.lower(F.hex("t_ref")), 12, "0"), F.lit("-"), _hash("episode_id", "pos")).alias("id"), (F.lit(base) + slot_order).alias("seq"), *SLOT, "subject_name", "name_key",
                "object_literal", F.col("sentence").alias("fact_text"), "episode_id", F.col("t_ref").alias("valid_at"), F.col("t_ref").alias("ingested_at"), "confidence", "salience", "is_inference",
            )
            facts = materialized(facts, "candidates")
            current = self.facts()
            prior = _for_fold(current.where("is_latest = 1").join(facts.select(*SLOT).distinct(), SLOT, "left_semi"))
            folded = materialized(resolve.fold(_for_fold(facts), SLOT, prior=prior, judge=steps.adjudicate), "folded").where("label <> 'skip'")
            keyed = facts.withColumn("slot", F.concat_ws("\u0001", *SLOT))
            written = keyed.join(folded.select("slot", "seq"), ["slot", "seq"], "left_semi").drop("slot")
            embedded = written.withColumn("embedding", self.embedder.column(F.col("fact_text")))
            embedded = embedded.withColumns({"coarse": truncate(F.col("embedding"), self.embedder.coarse), "record_kind": F.lit("fact")})
            self.store.append("fact_assert", embedded)
            self.store.append("posting", retrieve.postings(written))
            first = F.struct("valid_at", "seq")
            self.store.append(
                "entity",
                written.groupBy("namespace", "subject_id", "name_key").agg(F.min_by("subject_name", first).alias("name"), F.min("valid_at").alias("created_at")).withColumnRenamed("subject_id", "id"),
            )
            self._close(folded, keyed, current, base)
            return materialized(written, "written")

    def _close(self, folded: DataFrame, keyed: DataFrame, current: DataFrame, base: int) -> None:
        """Append the events of every supersession: old facts are those of this batch or current ones of their slot."""
        ids = keyed.select("slot", F.col("seq").alias("old_seq"), F.col("id").alias("fact_id")).unionByName(
            current.select(F.concat_ws("\u0001", *SLOT).alias("slot"), F.col("seq").alias("old_seq"), F.col("id").alias("fact_id"))
        )
        by = keyed.select("slot", "seq", F.col("id").alias("by_id"), F.col("valid_at").alias("at_ms"))
        closed = folded.where("label = 'supersedes'").select("slot", "seq", F.explode("closed").alias("old_seq")).join(ids, ["slot", "old_seq"]).join(by, ["slot", "seq"])
        closed = materialized(closed.select("fact_id", "by_id", "at_ms"), "closed")
        events = spine.closing_events(closed, current, self.store.read("fact_derivation"))
        self.store.append("fact_event", events.withColumn("seq", F.lit(base)))

    def facts(self, namespace: str | None = None) -> DataFrame:
        """The fact view of the whole store, or of one namespace: its assertions are read, and the events of these alone folded."""
        asserts, events = self.store.read("fact_assert"), self.store.read("fact_event")
        if namespace is not None:
            asserts = asserts.where(F.col("namespace") == namespace)
            events = events.join(asserts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi")
        return spine.current(asserts, events)

    def entities(self) -> DataFrame:
        """Each entity once: every batch names those it met, and the oldest spelling holds."""
        first = F.struct("created_at", "name")
        return self.store.read("entity").groupBy("id", "namespace", "name_key").agg(F.min_by("name", first).alias("name"), F.min("created_at").alias("created_at"))

    def entity_counts(self) -> DataFrame:
        return inspect.entity_counts(self.entities(), self.facts())

    # ── search ──
    def search(
        self, namespace: str, query: str, k: int = 5, as_of: int | None = None, is_latest_only: bool = True, now: int | None = None, include_cold: bool = False,
        pool: str = "exact", touch: bool = True,
    ) -> DataFrame:
        """Ranked hits, whose use is recorded unless touch=False. As in the engine's contract as_of alone still asks for latest facts; history needs is_latest_only=False."""
        at = now_ms() if now is None else now
        mine = self.facts(namespace)
        found = retrieve.search(mine, query, self.embedder.one(query), at, k, as_of, is_latest_only, include_cold, pool, self.embedder.coarse, self.index(namespace), self.strategies.rerank)
        if touch:
            found = materialized(found, "hits")
            self.store.append("fact_event", retrieve.touches(found, at).withColumn("seq", F.lit(self.store.next_batch() * BATCH)))
        return found

    def index(self, namespace: str) -> DataFrame:
        """The postings of a namespace; facts that were stored without any are split here."""
        stored = self.store.read("posting").where(F.col("namespace") == namespace)
        known = stored.where("term = ''").select(F.col("fact_id").alias("id"))
        rest = self.store.read("fact_assert").where(F.col("namespace") == namespace).join(known, "id", "left_anti")
        return stored.unionByName(retrieve.postings(rest))

    def history(self, namespace: str, as_of: int | None = None) -> DataFrame:
        return spine.surface(self.facts(namespace), as_of, is_latest_only=False)

    # ── maintenance ──
    def maintain(self, namespace: str, now: int | None = None, dry_run: bool = False, force: bool = False) -> dict[str, int]:
        """One run: proposals are staged, exact duplicates merged, worthless old facts made cold. Counts by kind, and of
        what the budget left out. Below the thresholds (see maintain.due) nothing is done but a row in the ledger, which
        keeps the last cursor; a dry run writes nothing and looks at no threshold."""
        at = now_ms() if now is None else now
        facts = materialized(self.facts(namespace), "snapshot")
        runs = self.store.read("maintenance_run").where((F.col("namespace") == namespace) & (F.col("status") == "ok"))
        last = runs.orderBy(F.desc("finished_at"), F.desc("id")).first()
        cursor = facts.agg(F.max("seq")).first()[0]  # before anything is written, so that a run's own rows come after it
        if not dry_run and not force and last is not None and last["cursor"] is not None:
            since = facts.where((F.col("seq") > last["cursor"]) & (F.col("is_latest") == 1) & (F.col("record_kind") != "summary"))
            if not maintain.due(since, last["finished_at"], at, self.config).first()["due"]:
                with self.store.unit():
                    self._ledger(str(self.store.next_batch() * BATCH), namespace, at, "ok", last["cursor"], {"below_threshold": 1})
                return {"below_threshold": 1}
        queue = self.proposals(namespace, at).where("status = 'pending'")
        named = lambda kind: F.from_json("payload_json", lifecycle.PAYLOADS[kind])
        ids = F.flatten(F.array(
            F.coalesce(named("dedup_near")["fact_ids"], F.array().cast("array<string>")), F.coalesce(named("summarize")["source_fact_ids"], F.array().cast("array<string>")),
            F.array_compact(F.array(named("evict")["fact_id"])),
        ))
        pending = queue.select("kind", ids.alias("ids"))
        transformed = maintain.transforms(facts, at, self.config, pending)
        if self.strategies.summarize is not None:
            transformed["summarize"] = summarized_by(transformed["summarize"], facts, self.strategies.summarize)
        found = {k: materialized(v, k) for k, v in transformed.items()}
        all_found = found.pop("found").count()
        counts = {k: v.count() for k, v in found.items()}
        counts["dropped"] = all_found - counts["dedup_near"] - counts["summarize"] - counts["evict"]
        if dry_run:
            return counts
        run_id = None
        try:
            with self.store.unit():
                base = self.store.next_batch() * BATCH
                run_id = str(base)
                self._stage(namespace, facts, found, base, at)
                self.store.heartbeat()
                self._ledger(run_id, namespace, at, "ok", cursor, counts)
        except Exception:
            if run_id is not None:
                self._ledger(run_id, namespace, at, "aborted", None, {})
            raise
        return counts

    def _ledger(self, run_id: str, namespace: str, at: int, status: str, cursor: int | None, stats: dict[str, int]) -> None:
        run = [(run_id, namespace, at, at, at, status, cursor, json.dumps(stats, sort_keys=True))]
        self.store.append("maintenance_run", self.spark.createDataFrame(run, "id string, namespace string, started_at long, heartbeat_at long, finished_at long, status string, cursor long, stats_json string"))

    def _stage(self, namespace: str, facts: DataFrame, found: dict[str, DataFrame], base: int, at: int) -> None:
        """Append a run's events and proposals."""
        merges = lifecycle.canonical_merges(found["merges"], facts)
        events = lifecycle.merge_events(merges, at).unionByName(lifecycle.repoint_events(merges, facts, at)).unionByName(lifecycle.tier_events(found["demotions"], "cold", at))
        self.store.append("fact_event", events.withColumn("seq", F.lit(base)))
        text = facts.select("id", "fact_text")
        near = found["dedup_near"].join(text.withColumnsRenamed({"id": "a", "fact_text": "ta"}), "a").join(text.withColumnsRenamed({"id": "b", "fact_text": "tb"}), "b")
        slot = F.split("slot", "\u0001")
        payloads = [
            near.select(F.lit("dedup_near").alias("kind"), F.to_json(F.struct(
                F.struct(F.get(slot, F.lit(0)).alias("subject_id"), F.get(slot, F.lit(1)).alias("predicate")).alias("slot"), F.array("a", "b").alias("fact_ids"),
                F.create_map("a", "ta", "b", "tb").alias("fact_texts"), "cosine", "multivalued", F.col("a").alias("proposed_survivor"), F.lit("stored").alias("evidence_backend"),
            )).alias("payload_json")),
            found["summarize"].select(F.lit("summarize").alias("kind"), F.to_json(F.struct("subject_id", "source_fact_ids", "summary_text", F.lit(self.strategies.summarize.backend_id if self.strategies.summarize else "stub").alias("evidence_backend"))).alias("payload_json")),
            found["evict"].select(F.lit("evict").alias("kind"), F.to_json(F.struct(F.col("id").alias("fact_id"), "fact_text", "value", "salience", "access_count", F.lit("stored").alias("evidence_backend"))).alias("payload_json")),
        ]
        staged = payloads[0].unionByName(payloads[1]).unionByName(payloads[2])
        staged = staged.withColumns({
            "id": _hash("kind", "payload_json", F.lit(str(base))), "run_id": F.lit(str(base)), "namespace": F.lit(namespace), "created_at": F.lit(at),
            "expires_at": F.lit(at + self.config.expiry_days * MS_PER_DAY), "evidence_backend": F.get_json_object("payload_json", "$.evidence_backend"),
        })
        self.store.append("maintenance_proposal", staged)

    def proposals(self, namespace: str, now: int | None = None) -> DataFrame:
        rows = self.store.read("maintenance_proposal").where(F.col("namespace") == namespace)
        return lifecycle.status(rows, self.store.read("proposal_decision"), now_ms() if now is None else now)

    def review_queue(self, namespace: str, limit: int = 20, now: int | None = None) -> DataFrame:
        subject = F.coalesce(F.get_json_object("payload_json", "$.subject_id"), F.get_json_object("payload_json", "$.slot.subject_id"), F.get_json_object("payload_json", "$.fact_id"))
        return lifecycle.review_queue(self.proposals(namespace, now).withColumn("subject_id", subject), limit)

    def promote(self, namespace: str, fact_id: str, now: int | None = None) -> str:
        """Make one fact hot: promoted or not_found."""
        at = now_ms() if now is None else now
        with self.store.unit():
            fact = self.facts(namespace).where(F.col("id") == fact_id)
            if fact.isEmpty():
                return "not_found"
            self.store.append("fact_event", lifecycle.tier_events(fact, "hot", at).withColumn("seq", F.lit(self.store.next_batch() * BATCH)))
        return "promoted"

    def decide(self, namespace: str, proposal_id: str, verdict: str, now: int | None = None, edited_text: str | None = None) -> str:
        """approve, reject, edit or promote a proposal: approved, edited, rejected, promoted, stale_target, the earlier
        status of one that is decided, invalid_decision (an edit of anything but a summary, a promotion of anything but
        an eviction) or not_found. Decision and effects are one unit of work."""
        if verdict not in ("approve", "reject", "edit", "promote"):
            raise ValueError(verdict)
        if verdict == "edit" and not edited_text:
            raise ValueError("edit needs edited_text")
        at = now_ms() if now is None else now
        with self.store.unit():
            row = self.proposals(namespace, at).where(F.col("id") == proposal_id).first()
            if row is None:
                return "not_found"
            if row["status"] != "pending":
                return row["status"]
            if verdict == "edit" and row["kind"] != "summarize" or verdict == "promote" and row["kind"] != "evict":
                return "invalid_decision"
            base = self.store.next_batch() * BATCH
            facts = self.facts(namespace)
            outcome, reason = ("rejected", None) if verdict == "reject" else ("approved", None)
            payload = self.spark.createDataFrame([(row["payload_json"],)], "j string").select(F.from_json("j", lifecycle.PAYLOADS[row["kind"]]).alias("p")).first()["p"]
            events = None
            if verdict == "promote":
                target = facts.where((F.col("id") == payload["fact_id"]) & (F.col("is_latest") == 1))
                if target.isEmpty():
                    outcome, reason = "expired", "stale_target"
                else:
                    outcome, reason, events = "rejected", "promoted", lifecycle.tier_events(target, "hot", at)
            elif verdict == "approve" and row["kind"] == "dedup_near":
                a, b = payload["proposed_survivor"], next(i for i in payload["fact_ids"] if i != payload["proposed_survivor"])
                merge = self.spark.createDataFrame([(a, b)], "a string, b string")
                if lifecycle.valid_merges(merge, facts).first()["ok"]:
                    pair = facts.where(F.col("id").isin(a, b))
                    usage = pair.agg(F.sum("access_count").alias("merged_access_count"), F.max(F.coalesce("last_access", "valid_at")).alias("merged_last_access"))
                    events = lifecycle.merge_events(usage.select(F.lit(a).alias("survivor_id"), F.array(F.lit(b)).alias("loser_ids"), "merged_access_count", "merged_last_access"), at)
                else:
                    outcome, reason = "expired", "stale_target"
            elif verdict == "approve" and row["kind"] == "evict":
                events = lifecycle.tier_events(facts.where((F.col("id") == payload["fact_id"]) & (F.col("is_latest") == 1)), "cold", at)
            elif verdict in ("approve", "edit"):
                events, outcome, reason = self._summarize(namespace, payload, facts, base, at, edited_text if verdict == "edit" else None)
            if events is not None:
                self.store.append("fact_event", events.withColumn("seq", F.lit(base)))
            decision = [(base, proposal_id, outcome, reason, at, at if events is not None else None)]
            self.store.append("proposal_decision", self.spark.createDataFrame(decision, "seq long, proposal_id string, status string, reason string, decided_at long, applied_at long"))
            return reason or outcome

    def _fits(self, facts: DataFrame) -> None:
        """Refuse an embedder whose vectors don't have the length of those stored."""
        stored = facts.where("embedding IS NOT NULL").select(F.size("embedding").alias("dim"), F.size("coarse").alias("coarse")).first()
        if stored is not None and (stored["dim"], stored["coarse"]) != (self.embedder.dim, self.embedder.coarse):
            raise ValueError(f"the embedder gives {self.embedder.dim} and {self.embedder.coarse} dimensions, the namespace has {stored['dim']} and {stored['coarse']}")

    def _summarize(self, namespace: str, payload, facts: DataFrame, base: int, at: int, edited: str | None = None):
        """Write an approved or edited summary and its episode: it is valid from now on, its sources become cold, an
        earlier summary is superseded."""
        self._fits(facts)
        text = edited or payload["summary_text"]
        sources = facts.where(F.col("id").isin(*payload["source_fact_ids"]))
        if sources.where("is_latest = 1").count() != len(payload["source_fact_ids"]):
            return None, "expired", "stale_target"
        new_id = f"{at:012x}-summary{base:x}"
        episode = (f"{at:012x}-episode{base:x}", namespace, text, "maintenance", at, at, base)
        self.store.append("episode", self.spark.createDataFrame([episode], self.store.read("episode").schema))
        row = self.spark.createDataFrame([(new_id, base + 1, namespace, payload["subject_id"], text, episode[0])], "id string, seq long, namespace string, subject_id string, fact_text string, episode_id string")
        vector = self.embedder.column(F.col("fact_text"))
        row = row.withColumns({
            "predicate": F.lit("summary"), "valid_at": F.lit(at), "ingested_at": F.lit(at), "record_kind": F.lit("summary"), "confidence": F.lit(1.0), "is_inference": F.lit(0),
            "salience": X.salience(F.col("fact_text"), F.lit(False), F.lit(False)), "embedding": vector,
        }).withColumn("coarse", truncate(F.col("embedding"), self.embedder.coarse))
        self.store.append("fact_assert", row)
        self.store.append("posting", retrieve.postings(row))
        self.store.append("fact_derivation", sources.select(F.lit(new_id).alias("summary_id"), F.col("id").alias("source_id")))
        before = facts.where((F.col("record_kind") == "summary") & (F.col("subject_id") == payload["subject_id"]) & (F.col("is_latest") == 1))
        closed = before.select(F.col("id").alias("fact_id"), F.lit("supersede").alias("kind"), F.lit(at).alias("at_ms"), F.lit(new_id).alias("ref_id"), F.lit(None).cast("string").alias("val"))
        return lifecycle.tier_events(sources, "cold", at).unionByName(closed), "edited" if edited else "approved", None

    def status(self, now: int | None = None) -> DataFrame:
        """Runs of each namespace, its pending proposals, and whether a run is overdue."""
        at = now_ms() if now is None else now
        waiting = lifecycle.status(self.store.read("maintenance_proposal"), self.store.read("proposal_decision"), at).where("status = 'pending'")
        waiting = waiting.groupBy("namespace").agg(F.count(F.lit(1)).alias("pending"))
        return self._stale(at).join(waiting, "namespace", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))

    def _stale(self, now: int) -> DataFrame:
        return lifecycle.stale(self.store.read("maintenance_run"), now, self.config.max_age_days)

    def overview(self) -> DataFrame:
        """Counts of each namespace, those with the most facts first."""
        return inspect.ranked(inspect.supersession_rate(inspect.overview(self.facts(), self.entities(), self.store.read("episode"))))


def _window(by: list[str], order: Column):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(order)


def _for_fold(facts: DataFrame) -> DataFrame:
    return facts.select(
        *SLOT, "seq", X.restatement_key("fact_text").alias("key"), F.col("object_literal").alias("object"), X.additive(F.col("fact_text"), F.col("predicate")).alias("additive"),
        F.col("predicate").isin(*X.MULTIVALUED).alias("multivalued"),
    )

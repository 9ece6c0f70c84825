"""Queries of lookups, the event fold, cascades, the resolver's bands, readers' parsers and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.embed import FakeEmbedder
from factloom.operators import evaluate, extract, inspect, lifecycle, lookup, maintain, resolve, retrieve, spine
from factloom.plans.inputs import EPISODES, EVENTS, NOW, SENTENCES, epoch_ms, episodes, event_facts, table
from factloom.plans.retrieval import _C, _Q, _VEC, COARSE, QUERY, QUERY_VECTOR, _cos, _RECENCY, _SPARSE_ALL
from factloom.plans.text import WORD
from factloom.sources import datasets, migrate

FACT, CURSOR = 137, 400
#: A day after the first event: some of the earliest facts are visible then.
SOON = 1_704_153_600_000
DAY = 86_400_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_facts(spark, sf_dir).withColumn("seq", F.col("id"))


# ── lookups ──
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_id(_events(spark, sf_dir), FACT).select("id", "subject_id", "predicate", "fact_text", "valid_at")


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_id(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), FACT)


def hydrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return lookup.hydrate(_events(spark, sf_dir), wanted).select("id", "fact_text", "salience")


def stored_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookup.embedding_of(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), FACT)
    return rows.select(F.posexplode("embedding").alias("place", "value")).select("place", F.round(F.col("value").cast("double"), 6).alias("value"))


def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest_after(_events(spark, sf_dir), CURSOR).select("id", "subject_id", "predicate")


def slot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.latest_in_slot(_events(spark, sf_dir), "46", "click").select("id", "tier", "valid_at")


def fact_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact with its whole chain, oldest first, and its subject."""
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    facts = _events(spark, sf_dir).withColumn("episode_id", F.col("id"))
    fact, chain, _ = lookup.fact_detail(facts, entities, facts.select("id"), FACT)
    return chain.select("id", F.col("step").cast("long").alias("step"), "valid_at").crossJoin(F.broadcast(fact.select("subject_name")))  # one row


def episode_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes(spark, sf_dir).withColumn("id", F.col("namespace") * 1000 + F.col("seq"))
    return lookup.list_episodes(rows, page=2, page_size=30).select("id", "namespace", "source", "t_ref")


def episode_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of one episode: orders as facts of the day that gave them."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 200).alias("episode_id"), F.col("o_orderstatus").alias("predicate"))
    return lookup.episode_facts(spark.range(200), facts, FACT)


def derived_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest summaries that derive from closed facts: every summary event derives from the two events before it."""
    facts = _events(spark, sf_dir)
    return lookup.stale_summaries(_derivations(facts), facts, facts.where("is_latest = 0")).select("id", "subject_id")


def _derivations(facts: DataFrame) -> DataFrame:
    return facts.where("record_kind = 'summary'").select(F.col("id").alias("summary_id"), F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("source_id"))


def retired_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("fact_text"))
    return lookup.retired_values(rows, "License", "MIT").select("id")


def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that hold a term, and how many match."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("fact_text"), F.lit(1).alias("is_latest"), F.col("doc_id").alias("created_at"))
    page, total = inspect.list_facts(rows, q="the License", page_size=40)
    return page.select("id").crossJoin(F.broadcast(total))  # one row


def namespace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_nationkey") % 5 == 0, "_").otherwise(""), F.col("c_mktsegment")).alias("namespace"))
    return inspect.open_namespaces(rows)


def namespace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of facts, entities and episodes by namespace, ranked, with facts for each add."""
    facts = event_facts(spark, sf_dir)
    entities = facts.select("namespace", "subject_id").distinct()
    turns = episodes(spark, sf_dir).select((F.col("namespace") % 10).alias("namespace"))
    over = inspect.overview(facts, entities, turns)
    adds = inspect.activity(facts.select("namespace", F.col("valid_at").alias("ts"), F.when(F.col("id") % 2 == 0, "add").otherwise("search").alias("kind"), F.lit("{}").alias("payload")), NOW, 90)
    ranked = inspect.ranked(inspect.facts_per_add(over, adds))
    return ranked.select("namespace", "facts_latest", "facts_retired", "chains", "entities", "episodes", F.round("facts_per_add", 6).alias("facts_per_add"))


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("namespace"), epoch_ms("ts").alias("ts"), F.col("event_type").alias("kind"))
    return inspect.list_events(rows, 3, "click", page=2, page_size=20)


def upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and entities of the first schema version, brought to the current one."""
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("access_count"), F.when(F.col("o_orderkey") % 2 == 0, 4.0).alias("salience"))
    facts, entities = migrate.upgrade(facts, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name")), 0)
    keys = entities.select(F.col("id"), "name_key")
    return facts.select("id", "tier", "record_kind", "access_count", "is_inference", "salience").join(keys, "id")


# ── the event fold and cascades ──
def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as assertions, their lines as events: the line's number gives the kind."""
    asserts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("touch", "usage_merge", "touch", "tier", "supersede", "retire_duplicate", "invalidate")]), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"))
    events = rows.select(
        (F.col("part") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("fact_id"), kinds.alias("kind"), F.col("part").alias("at_ms"), F.col("supp").alias("ref_id"),
        F.when(F.col("l_linenumber") == 4, F.when(F.col("supp") % 2 == 0, "cold").otherwise("hot")).when(F.col("l_linenumber") == 2, F.col("supp").cast("string")).alias("val"),
    )
    return asserts, events


def current_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with all their events folded: closings, tiers, merges of usage and touches after them."""
    none = lambda c: F.coalesce(c, F.lit(-1))
    view = spine.current(*_log(spark, sf_dir))
    return view.select("id", none("valid_to").alias("valid_to"), none("superseded_by").alias("superseded_by"), none("invalidated_by").alias("invalidated_by"), "tier", "is_latest", "access_count", none("last_access").alias("last_access"))


def supersede_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing every 7th latest fact entails: its open duplicates close, summaries of any of them go stale."""
    facts = _events(spark, sf_dir).withColumns({"valid_to": F.when(F.col("id") % 2 == 0, F.col("valid_to"))})
    closed = facts.where("is_latest = 1 AND id % 7 = 0").select(F.col("id").alias("fact_id"), (F.col("id") + 1_000_000).alias("by_id"), (F.lit(NOW) + F.col("id")).alias("at_ms"))
    return spine.closing_events(closed, facts, _derivations(facts)).select("fact_id", "kind", "at_ms", "ref_id")


def merge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed merges of neighbouring events, as they hold at the time of the decision."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("subject_id"), F.col("event_type").alias("predicate"))
    facts = rows.withColumns({"is_latest": (F.col("id") % 3 != 0).cast("int"), "valid_to": F.when(F.col("id") % 4 == 0, F.lit(NOW))})
    merges = facts.select(F.col("id").alias("a"), (F.col("id") + 50).alias("b"))
    return lifecycle.valid_merges(merges, facts).groupBy("ok").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("ids"))


def retire_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges onto live canonicals, and the open duplicates that then point elsewhere."""
    facts = _events(spark, sf_dir).withColumn("valid_to", F.when(F.col("id") % 2 == 0, F.col("valid_to")))
    merges = facts.where("id % 5 = 0").select(F.col("id").alias("survivor_id"), F.array(F.col("id") + 1, F.col("id") + 2).alias("loser_ids"))
    merges = lifecycle.canonical_merges(merges, facts)
    retired = lifecycle.merge_events(merges.withColumns({"merged_access_count": F.lit(1), "merged_last_access": F.lit(1).cast("long")}), NOW).where("kind = 'retire_duplicate'")
    events = retired.unionByName(lifecycle.repoint_events(merges, facts, NOW))
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("fact_id").alias("facts"), F.sum("ref_id").alias("refs"))


def pending_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of which none with the same facts, in whatever order, waits for a decision."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.array("l_suppkey", "l_linenumber").alias("fact_ids"))
    waiting = table(spark, sf_dir, "lineitem").where("l_linenumber = 2 AND l_suppkey % 3 = 0").select(F.array(F.lit(1).cast("long"), F.col("l_suppkey")).alias("ids"))
    found = lifecycle.not_pending(rows.withColumn("fact_ids", F.col("fact_ids").cast("array<bigint>")), waiting, "fact_ids", "ids")
    return found.select("l_orderkey", F.array_join("fact_ids", ",").alias("facts"))


def tier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that an automatic demotion makes cold, as the view shows them afterwards."""
    facts = _events(spark, sf_dir).withColumns({"is_latest": F.lit(1), "tier": F.lit("hot")})
    cold = maintain.evict_auto(facts, NOW + 400 * DAY)
    events = lifecycle.tier_events(cold, "cold", NOW).withColumn("seq", F.lit(1))
    return spine.current(facts.select("id"), events.select("seq", "fact_id", "kind", "at_ms", "ref_id", "val")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


# ── resolver, search, ledger ──
def resolver_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors as slots of two facts: the second one's label and route by similarity, cues and words."""
    words = F.when(F.col("vec_id") % 4 == 0, "red").when(F.col("vec_id") % 4 == 1, "red car").otherwise(F.concat(F.lit("o"), F.col("vec_id")))
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("pair"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("string").alias("key"), words.alias("object"), (F.col("vec_id") % 3 == 0).alias("additive"),
        (F.col("vec_id") % 10 == 1).alias("multivalued"), "embedding",
    )
    return resolve.fold(rows, ["pair"], "embedding", high=0.1, low=-0.05, judge=lambda new, old: "extends" if len(new) > 4 else "other").select("seq", "label", "route")


def resolver_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.escalation_rate(resolver_bands(spark, sf_dir)).select(F.round("rate", 9).alias("rate"))


def parity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search by bounded pools, as of a time: events with the texts and vectors of the same ids."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    facts = event_facts(spark, sf_dir).drop("fact_text").join(texts.withColumnRenamed("text", "fact_text"), "id").join(vectors, "id")
    found = retrieve.search(facts, QUERY, QUERY_VECTOR, NOW, k=20, as_of=SOON, is_latest_only=False, pool="parity", coarse_dim=COARSE)
    return found.select("id", F.col("fused_rank").cast("long").alias("fused_rank"), F.round("final_score", 6).alias("final_score"))


def touched_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of facts after searches touched them: each event is a hit of its user's search."""
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    events = retrieve.touches(hits, NOW).select(F.lit(1).alias("seq"), "fact_id", "kind", "at_ms", F.lit(None).cast("long").alias("ref_id"), F.lit(None).cast("string").alias("val"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return spine.current(users, events).select("id", "access_count", F.coalesce("last_access", F.lit(0)).alias("last_access"))


def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by namespace: their count, the last one and its status, the last good one, and whether one is overdue."""
    runs = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 9).alias("namespace"), F.col("o_orderkey").alias("id"), epoch_ms("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderkey") % 4 != 0, epoch_ms("o_orderdate") + 5).alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("aborted").alias("status"),
    )
    return lifecycle.stale(runs, 901_000_000_000).select("namespace", "runs", "last_run", "last_status", "last_ok", "is_stale")


def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-sortable ids: 12 hexadecimal digits of the time, then of a digest."""
    from factloom.memory import _hash

    rows = _events(spark, sf_dir)
    return rows.select("seq", F.concat(F.lpad(F.lower(F.hex("valid_at")), 12, "0"), F.lit("-"), _hash("id", "predicate")).alias("fact_id"))


def payloads_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of evictions written as JSON and read back; broken ones read as nothing."""
    facts = _events(spark, sf_dir)
    text = F.to_json(F.struct(F.col("id").cast("string").alias("fact_id"), "fact_text", "salience"))
    rows = facts.select("id", F.when(F.col("id") % 9 == 0, F.lit("{broken")).otherwise(text).alias("j")).withColumn("p", F.from_json("j", lifecycle.PAYLOADS["evict"]))
    return rows.select("id", F.coalesce("p.fact_id", F.lit("")).alias("fact_id"), F.coalesce("p.fact_text", F.lit("")).alias("fact_text"))


# ── readers' parsers, judges, prompts ──
def session_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both spellings of session dates, read back to the minute."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    one = datasets.parse_session_date(F.date_format("ts", "yyyy/MM/dd '('EEE')' HH:mm"))
    two = datasets.parse_spoken_date(F.lower(F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")))
    return rows.select("event_id", one.alias("session_ms"), two.alias("spoken_ms"))


def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a resumed job that have no result yet."""
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"))
    return datasets.pending(units, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("unit")), "unit")


def judge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's outputs in all their spellings, and gold answers cut at the first semicolon."""
    out = F.when(F.col("doc_id") % 5 == 0, '{"label": "correct"}').when(F.col("doc_id") % 5 == 1, 'so: {"label":"WRONG"} CORRECT').when(F.col("doc_id") % 5 == 2, "INCORRECT, hence wrong").when(F.col("doc_id") % 5 == 3, "Correct.").otherwise("correct or wrong")
    rows = table(spark, sf_dir, "documents").select("doc_id", out.alias("out"), (F.col("doc_id") % 4).alias("category"), F.concat(F.col("source"), F.lit(" ; "), F.col("lang")).alias("gold"))
    return rows.select("doc_id", F.coalesce(evaluate.parse_label(F.col("out")).cast("string"), F.lit("unclear")).alias("label"), evaluate.truncate_gold(F.col("category"), F.col("gold")).alias("gold"))


def reader_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _events(spark, sf_dir).where("id < 12").withColumn("rank", -F.col("id"))
    return evaluate.render_prompt(hits, "what was it?")


def relation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations, who may give them, whether they retire facts, and the predicate that stands for an empty one."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("Asserts", " supersedes ", "EXTENDS", "derives", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    relation = X.relation_from_str(said)
    return table(spark, sf_dir, "part").select(
        "p_partkey", relation.alias("relation"), X.is_llm_only(relation).alias("llm_only"), X.triggers_versioning(relation).alias("versioning"),
        X.predicate_or_default(F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.col("p_brand"))).alias("predicate"),
    )


def rules_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older extractor over conversations, every fifth turn with a date."""
    rows = episodes(spark, sf_dir).withColumn("raw", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("I live in Rome since 2023-02-03. Then Anna works at Acme. "), "raw")).otherwise(F.col("raw")))
    return extract.rules_candidates(rows).select("namespace", "seq", F.col("pos").cast("long").alias("pos"), "subject_name", "predicate", "valid_at", "confidence")


def fake_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in's vectors: of unit length, and equal for equal texts alone."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("t")).withColumn("v", FakeEmbedder(16, 4).column(F.col("t")))
    length: Column = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.groupBy("t").agg(F.count_distinct("v").cast("int").alias("vectors"), F.round(F.max(length), 4).alias("length"), F.max(F.size("v")).alias("dim"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_lookup, entity_lookup, hydrate_ids, stored_embedding, latest_scan, slot_current, fact_chain, episode_page, episode_detail, derived_from, retired_value, text_filter, namespace_list,
        namespace_totals, event_page, upgraded, current_view, supersede_cascade, merge_validation, retire_repoint, pending_signatures, tier_changes, resolver_bands, resolver_escalation,
        parity_search, touched_facts, run_ledger, fact_ids, payloads_read, session_dates, pending_units, judge_labels, reader_prompt, relation_flags, rules_extract, fake_embeddings,
    )
}
_DERIVED = "dv AS (SELECT id AS summary_id, unnest([id - 1, id - 2]) AS source_id FROM ev WHERE record_kind = 'summary')"
_OPEN = "op AS (SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN valid_to END AS valid_to) FROM ev)"
_BANDS = f"""{_VEC},
w AS (SELECT id, e, CASE id % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'red car' ELSE 'o' || id END AS obj FROM ve),
p AS (SELECT b.id, round({_cos('a.e', 'b.e')}, 12) AS sim, a.obj AS old, b.obj AS new, b.id % 3 = 0 AS additive, b.id % 10 = 1 AS multi FROM w a JOIN w b ON b.id = a.id + 1 AND a.id % 2 = 0),
rb AS (
  SELECT id AS seq, 'asserts' AS label, 'no_slot' AS route FROM ve WHERE id % 2 = 0 UNION ALL
  SELECT id, CASE WHEN sim >= 0.1 THEN CASE WHEN old = 'red' AND new = 'red car' OR multi THEN 'extends' ELSE 'supersedes' END
      WHEN additive THEN 'extends' WHEN sim > -0.05 AND length(new) > 4 THEN 'extends' ELSE 'supersedes' END,
    CASE WHEN sim >= 0.1 THEN CASE WHEN old = 'red' AND new = 'red car' THEN 'high_extends' WHEN multi THEN 'high_extends_additive' ELSE 'high_supersedes' END
      WHEN sim <= -0.05 THEN CASE WHEN additive THEN 'low_extends' ELSE 'low_supersedes' END WHEN additive THEN 'mid_extends' ELSE 'llm' END FROM p)"""
_LOG = """ln AS (SELECT l_orderkey AS id, l_linenumber AS n, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL),
mg AS (SELECT id, part * 10 + 2 AS seq, supp FROM ln WHERE n = 2)"""
_SEEN = "valid_at <= {0} AND (valid_to IS NULL OR valid_to > {0})".format(SOON)
_RULES = rf"""WITH {SENTENCES.replace("coalesce(text, '') AS raw", "CASE WHEN turn % 5 = 0 THEN 'I live in Rome since 2023-02-03. Then Anna works at Acme. ' ELSE '' END || coalesce(text, '') AS raw")},
ru AS (
  SELECT *, CASE {" ".join(f"WHEN {WORD(p)} THEN '{n}'" for n, p in X.RULE_VERBS)} END AS predicate,
    list_transform(string_split_regex(trim(sentence, E' \n\t\r'), '\s+'), lambda w: trim(w, '.,!?;:''"')) AS ws, nullif(regexp_extract(sentence, '(?:^|[^\w])(\d{{4}}-\d{{2}}-\d{{2}})(?:[^\w]|$)', 1), '') AS day FROM sp)
SELECT namespace, seq, pos, CASE WHEN {WORD(X.RULE_FIRST_PERSON)} THEN 'user' ELSE coalesce(list_filter(ws, lambda w: regexp_matches(w, '^\p{{Lu}}'))[1], ws[1]) END AS subject_name, predicate,
  coalesce(epoch_ms(day::TIMESTAMP) + t_ref % 86400000, t_ref) AS valid_at, 0.6::DOUBLE AS confidence FROM ru WHERE predicate IS NOT NULL"""
ORACLES = {
    "fact_lookup": f"WITH {EVENTS} SELECT id, subject_id, predicate, fact_text, valid_at FROM ev WHERE id = {FACT}",
    "entity_lookup": f"SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = {FACT}",
    "hydrate_ids": f"WITH {EVENTS} SELECT id, fact_text, salience FROM ev WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "stored_embedding": f"SELECT (unnest(range(len(embedding))))::INT AS place, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings WHERE vec_id = {FACT}",
    "latest_scan": f"WITH {EVENTS} SELECT id, subject_id, predicate FROM ev WHERE is_latest = 1 AND id > {CURSOR}",
    "slot_current": f"WITH {EVENTS} SELECT id, tier, valid_at FROM ev WHERE subject_id = '46' AND predicate = 'click' AND is_latest = 1",
    "fact_chain": f"""WITH RECURSIVE {EVENTS},
fw AS (SELECT id, superseded_by, valid_at, 0::BIGINT AS step FROM ev WHERE id = {FACT} UNION ALL SELECT ev.id, ev.superseded_by, ev.valid_at, fw.step + 1 FROM fw JOIN ev ON ev.id = fw.superseded_by),
bw AS (SELECT id, valid_at, 0::BIGINT AS step FROM ev WHERE id = {FACT} UNION ALL SELECT ev.id, ev.valid_at, bw.step - 1 FROM bw JOIN ev ON ev.superseded_by = bw.id)
SELECT a.id, step, a.valid_at, c_name AS subject_name FROM (SELECT id, step, valid_at FROM fw UNION ALL SELECT id, step, valid_at FROM bw WHERE step < 0) a, ev f JOIN customer ON c_custkey::VARCHAR = f.subject_id WHERE f.id = {FACT}""",
    "episode_page": f"WITH {EPISODES} SELECT namespace * 1000 + seq AS id, namespace, source, t_ref FROM ep ORDER BY t_ref DESC, id DESC LIMIT 30 OFFSET 30",
    "episode_detail": f"SELECT o_orderkey AS seq, o_custkey % 200 AS episode_id, o_orderstatus AS predicate FROM orders WHERE o_custkey % 200 = {FACT}",
    "derived_from": f"WITH {EVENTS}, {_DERIVED} SELECT id, subject_id FROM ev WHERE is_latest = 1 AND id IN (SELECT summary_id FROM dv JOIN ev s ON s.id = source_id AND s.is_latest = 0)",
    "retired_value": "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license') AND NOT contains(lower(text), 'mit')",
    "text_filter": r"""WITH m AS (SELECT doc_id AS id FROM documents WHERE len(list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda t: t IN ('the', 'license'))) > 0)
SELECT id, (SELECT count(*) FROM m) AS total FROM m ORDER BY id DESC LIMIT 40""",
    "namespace_list": "SELECT DISTINCT c_mktsegment AS namespace FROM customer WHERE c_nationkey % 5 <> 0",
    "namespace_totals": f"""WITH {EVENTS}, {EPISODES},
f AS (SELECT namespace, count_if(is_latest = 1)::BIGINT AS facts_latest, count_if(is_latest = 0)::BIGINT AS facts_retired, count(superseded_by) AS chains, count(DISTINCT subject_id) AS entities,
  count_if(id % 2 = 0 AND valid_at >= {NOW - 90 * DAY})::BIGINT AS adds, count(*) AS n FROM ev GROUP BY namespace),
e AS (SELECT namespace % 10 AS namespace, count(*) AS episodes FROM ep GROUP BY 1)
SELECT namespace, coalesce(facts_latest, 0) AS facts_latest, coalesce(facts_retired, 0) AS facts_retired, coalesce(chains, 0) AS chains, coalesce(entities, 0) AS entities, coalesce(episodes, 0) AS episodes,
  round(n / nullif(adds, 0)::DOUBLE, 6) AS facts_per_add FROM f FULL JOIN e USING (namespace)""",
    "event_page": "SELECT event_id AS id, user_id % 10 AS namespace, epoch_ms(ts) AS ts, event_type AS kind FROM events WHERE user_id % 10 = 3 AND event_type = 'click' ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 20",
    "upgraded": """SELECT o_orderkey AS id, 'hot' AS tier, 'fact' AS record_kind, o_orderkey % 3 AS access_count, 0 AS is_inference, CASE WHEN o_orderkey % 2 = 0 THEN 4.0 ELSE 0.0 END::DOUBLE AS salience, lower(c_name) AS name_key
FROM orders JOIN customer ON c_custkey = o_orderkey""",
    "current_view": f"""WITH {_LOG}
SELECT o.o_orderkey AS id, coalesce(arg_max(part, part * 10 + n) FILTER (n IN (5, 7)), -1) AS valid_to, coalesce(arg_max(ln.supp, part * 10 + n) FILTER (n IN (5, 6)), -1) AS superseded_by,
  coalesce(arg_max(ln.supp, part * 10 + n) FILTER (n = 7), -1) AS invalidated_by, coalesce(max(CASE WHEN n = 4 THEN CASE WHEN ln.supp % 2 = 0 THEN 'cold' ELSE 'hot' END END), 'hot') AS tier,
  CASE WHEN count(*) FILTER (n IN (5, 6, 7)) > 0 THEN 0 ELSE 1 END AS is_latest,
  coalesce(max(mg.supp), 0) + count(*) FILTER (n IN (1, 3) AND part * 10 + n > coalesce(mg.seq, -1)) AS access_count, coalesce(max(part) FILTER (n IN (1, 2, 3)), -1) AS last_access
FROM orders o LEFT JOIN ln ON ln.id = o.o_orderkey LEFT JOIN mg ON mg.id = o.o_orderkey GROUP BY o.o_orderkey""",
    "supersede_cascade": f"""WITH {EVENTS}, {_DERIVED}, {_OPEN},
c AS (SELECT id AS fact_id, id + 1000000 AS by_id, {NOW} + id AS at_ms FROM op WHERE is_latest = 1 AND id % 7 = 0),
g AS (SELECT fact_id, 'supersede' AS kind, at_ms, by_id AS ref_id FROM c UNION ALL SELECT d.id, 'cascade_close', at_ms, by_id FROM op d JOIN c ON d.superseded_by = c.fact_id WHERE d.is_latest = 0 AND d.valid_to IS NULL)
SELECT * FROM g UNION ALL SELECT summary_id, 'invalidate', min(at_ms), min(ref_id) FROM dv JOIN g ON source_id = fact_id WHERE summary_id IN (SELECT id FROM op WHERE is_latest = 1) GROUP BY summary_id""",
    "merge_validation": """WITH e AS (SELECT event_id AS id, user_id % 5 AS subject_id, event_type AS predicate FROM events), l AS (SELECT * FROM e WHERE id % 3 <> 0 AND id % 4 <> 0)
SELECT coalesce(a.subject_id = b.subject_id AND a.predicate = b.predicate, false) AS ok, count(*) AS n, sum(e.id)::BIGINT AS ids FROM e LEFT JOIN l a ON a.id = e.id LEFT JOIN l b ON b.id = e.id + 50 GROUP BY 1""",
    "retire_repoint": f"""WITH {EVENTS}, {_OPEN},
m AS (SELECT CASE WHEN is_latest = 0 THEN superseded_by ELSE id END AS s, id FROM op WHERE id % 5 = 0), l AS (SELECT s, unnest([id + 1, id + 2]) AS loser FROM m), k AS (SELECT * FROM l WHERE loser <> s)
SELECT 'retire_duplicate' AS kind, count(*) AS n, sum(loser)::BIGINT AS facts, sum(s)::BIGINT AS refs FROM k
UNION ALL SELECT 'repoint', count(*), sum(op.id)::BIGINT, sum(s)::BIGINT FROM op JOIN k ON op.superseded_by = k.loser WHERE is_latest = 0 AND valid_to IS NULL""",
    "pending_signatures": """SELECT l_orderkey, l_suppkey || ',1' AS facts FROM lineitem WHERE l_linenumber = 1 AND l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 3 = 0)""",
    "tier_changes": f"""WITH {EVENTS} SELECT CASE WHEN record_kind <> 'summary' AND salience < 2 AND access_count = 0 AND {NOW + 400 * DAY} - valid_at > {180 * DAY} THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n, sum(id)::BIGINT AS ids FROM ev GROUP BY 1""",
    "resolver_bands": f"WITH {_BANDS} SELECT * FROM rb",
    "resolver_escalation": f"WITH {_BANDS} SELECT round(avg((route = 'llm')::INT::DOUBLE), 9) AS rate FROM rb",
    "parity_search": f"""WITH {EVENTS}, {_VEC}, fa AS (SELECT ev.*, e, text FROM ev JOIN ve USING (id) JOIN documents ON doc_id = id),
po AS (SELECT * FROM fa ORDER BY round(1 - {_cos(f'e[1:{COARSE}]', _C)}, 9), id LIMIT 320),
dn AS (SELECT id, row_number() OVER (ORDER BY d, id) AS dense_rank FROM (SELECT id, round(1 - {_cos('e', _Q)}, 9) AS d FROM po WHERE {_SEEN}) QUALIFY dense_rank <= 40),
dt AS (SELECT id AS doc_id, text FROM fa), {_SPARSE_ALL.replace('FROM documents', 'FROM dt')},
bp AS (SELECT * FROM bm ORDER BY bm25 DESC, id LIMIT 80),
sq AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS sparse_rank FROM bp JOIN ev USING (id) WHERE {_SEEN} QUALIFY sparse_rank <= 40),
fj AS (SELECT id, dense_rank, sparse_rank, round(coalesce(1.0::DOUBLE / (10 + dense_rank), 0) + coalesce(1.0::DOUBLE / (10 + sparse_rank), 0), 12) AS rrf FROM dn FULL JOIN sq USING (id)),
fu AS (SELECT id, row_number() OVER (ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM fj QUALIFY fused_rank <= 40),
mm AS (SELECT id, fused_rank, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (count(*) OVER () - fused_rank)::DOUBLE / (count(*) OVER () - 1) END AS relevance FROM fu),
sc AS (SELECT id, fused_rank, round(0.6 * relevance + 0.2 * {_RECENCY} + 0.2 * salience / 10, 9) AS final FROM mm JOIN ev USING (id))
SELECT id, fused_rank, round(final, 6) AS final_score FROM sc ORDER BY final DESC, fused_rank LIMIT 20""",
    "touched_facts": f"SELECT c_custkey AS id, count(event_id) AS access_count, CASE WHEN count(event_id) > 0 THEN {NOW} ELSE 0 END AS last_access FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey",
    "run_ledger": """WITH r AS (SELECT o_custkey % 9 AS namespace, o_orderkey AS id, epoch_ms(o_orderdate) AS s, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_ms(o_orderdate) + 5 END AS f, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'aborted' END AS status FROM orders),
a AS (SELECT namespace, count(*) AS runs, max(CASE WHEN status = 'ok' THEN f END) AS last_ok FROM r GROUP BY namespace), l AS (SELECT namespace, id AS last_run, status AS last_status FROM r QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY coalesce(f, s) DESC, id DESC) = 1)
SELECT namespace, runs, last_run, last_status, last_ok, last_ok IS NULL OR 901000000000 - last_ok >= 604800000 AS is_stale FROM a JOIN l USING (namespace)""",
    "fact_ids": f"WITH {EVENTS} SELECT id AS seq, lpad(printf('%x', valid_at), 12, '0') || '-' || sha256(id || chr(1) || predicate)[1:16] AS fact_id FROM ev",
    "payloads_read": f"WITH {EVENTS} SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE id::VARCHAR END AS fact_id, CASE WHEN id % 9 = 0 THEN '' ELSE fact_text END AS fact_text FROM ev",
    "session_dates": "SELECT event_id, epoch_ms(date_trunc('minute', ts)) AS session_ms, epoch_ms(date_trunc('minute', ts)) AS spoken_ms FROM events",
    "pending_units": "SELECT c_custkey AS unit FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "judge_labels": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'false' WHEN 3 THEN 'true' ELSE 'unclear' END AS label,
  CASE WHEN doc_id % 4 = 3 THEN source ELSE source || ' ; ' || lang END AS gold FROM documents""",
    "reader_prompt": f"""WITH {EVENTS} SELECT string_agg('- [' || strftime(make_timestamp(valid_at * 1000), '%Y-%m-%d') || '] ' || fact_text, chr(10) ORDER BY -id) || chr(10) || chr(10) || 'Question: what was it?' AS prompt FROM ev WHERE id < 12""",
    "relation_flags": """SELECT p_partkey, ['asserts', 'supersedes', 'extends', 'derives', 'asserts'][p_partkey % 5 + 1] AS relation, p_partkey % 5 = 3 AS llm_only, p_partkey % 5 = 1 AS versioning,
  CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'about' END AS predicate FROM part""",
    "rules_extract": _RULES,
    "fake_embeddings": "SELECT DISTINCT p_type AS t, 1 AS vectors, 1.0::DOUBLE AS length, 16 AS dim FROM part",
}

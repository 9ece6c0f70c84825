"""Queries over the spine: slots, visibility, chains, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import extract, inspect, lookup, resolve, spine
from factloom.plans.inputs import EVENTS, NOW, epoch_ms, episodes, event_facts, table
from factloom.plans.text import NORMAL, RESTATED, ROUTED, WORD

HOUR = 3_600_000
GRID = [1_704_067_200_000 + i * 72 * HOUR for i in range(11)]
MID = GRID[5]


def slot_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as facts whose object is the JSON value, additive where the value is small, in a multivalued slot by kind."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("predicate"), F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("object"), (F.col("event_id") % 4 == 0).alias("cue"), (F.length("event_type") % 2 == 0).alias("multivalued"),
    )
    key = F.concat_ws(" ", "predicate", "object")
    return rows.select("subject_id", "predicate", "seq", key.alias("key"), "object", (F.col("cue") | F.col("multivalued")).alias("additive"), "multivalued")


def slot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = resolve.fold(slot_facts(spark, sf_dir), ["subject_id", "predicate"])
    return folded.select("seq", "label", F.array_join(F.array_sort("closed"), ",").alias("closed"))


def slot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is current in each slot after the fold."""
    folded = resolve.fold(slot_facts(spark, sf_dir), ["subject_id", "predicate"]).where("label <> 'skip'")
    closed = folded.select(F.explode("closed").alias("seq")).distinct()
    current = folded.select("slot", "seq").join(closed, "seq", "left_anti")
    return current.groupBy(F.substring_index("slot", "\u0001", 1).alias("subject_id"), F.substring_index("slot", "\u0001", -1).alias("predicate")).agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest")
    )


def supersession_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of conversations and those they close."""
    found = extract.typed(extract.route(extract.candidates(episodes(spark, sf_dir))))
    place = F.col("seq") * 1_000_000 + F.when(F.col("escalated"), 0).otherwise(500_000) + F.col("pos")
    rows = found.select(
        "namespace", X.entity_key("subject_name").alias("subject_key"), "predicate", place.alias("seq"), X.restatement_key("sentence").alias("key"), F.col("object_literal").alias("object"),
        X.additive(F.col("sentence"), F.col("predicate")).alias("additive"), F.col("predicate").isin(*X.MULTIVALUED).alias("multivalued"),
    )
    folded = resolve.fold(rows, ["namespace", "subject_key", "predicate"])
    closing = folded.where("label = 'supersedes'").withColumn("namespace", F.substring_index("slot", "\u0001", 1).cast("long"))
    return closing.select("namespace", F.col("seq").alias("new_seq"), "route", F.explode("closed").alias("old_seq"))


def spine_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_facts(spark, sf_dir)
    return rows.select("id", "subject_id", "predicate", "valid_at", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"), F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), "is_latest")


def latest_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderkey").alias("id"), epoch_ms("o_orderdate").alias("valid_at"))
    newest = F.max_by(F.struct("id", "valid_at"), F.struct("valid_at", "id")).alias("f")
    return rows.groupBy("subject_id", "predicate").agg(newest).select("subject_id", "predicate", "f.id", "f.valid_at")


def as_of_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spine.surface(event_facts(spark, sf_dir), as_of=MID, is_latest_only=False)
    return seen.select("id", "subject_id", "predicate", "valid_at", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


def as_of_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.as_of_grid(event_facts(spark, sf_dir), GRID, ["predicate"])


def tier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each combination of as_of, latest and cold, in one pass over the facts."""
    visible = spine.visible_at(F.col("valid_at"), F.col("valid_to"), MID)
    latest, hot = F.col("is_latest") == 1, F.col("tier") == "hot"
    cases = {"default": latest & hot, "cold": latest, "as_of_latest": visible & latest, "as_of_history": visible, "history": F.lit(True)}
    counts = event_facts(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in cases.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("surface"), F.col(n).alias("n")) for n in cases])).alias("x")).select("x.*")


def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain, from the fact that supersedes none."""
    facts = event_facts(spark, sf_dir).select("id", "superseded_by")
    later = facts.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("id"))
    start = facts.select("id").join(later, "id", "left_anti")
    return spine.chains(facts, start).withColumn("step", F.col("step").cast("long"))


def superseded_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = event_facts(spark, sf_dir)
    mine = facts.where("tier = 'cold'").select(F.col("id").alias("superseded_by"))
    return facts.join(mine, "superseded_by", "left_semi").select("id", "superseded_by")


def touched_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.slots_touched(event_facts(spark, sf_dir).withColumn("seq", F.col("valid_at")), MID)


def ns_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = inspect.supersession_rate(inspect.overview(event_facts(spark, sf_dir)))
    return over.withColumn("supersession_rate", F.round("supersession_rate", 6))


def top_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.top_predicates(event_facts(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"))
    return inspect.entity_counts(customers, facts)


def facts_with_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as facts, with the names of their customers."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("predicate"))
    return lookup.with_subject(facts, customers)


def list_facts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = event_facts(spark, sf_dir).withColumn("created_at", F.col("valid_at"))
    page, _ = inspect.list_facts(facts, min_salience=3.0, page=2, page_size=25)
    return page.select("id", "subject_id", "predicate", "fact_text", "salience")


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("event_id") % 2 == 0, "add").otherwise("search")
    origin = F.when(F.col("event_id") % 10 == 0, '{"origin":"ui"}').otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("namespace"), epoch_ms("ts").alias("ts"), kinds.alias("kind"), origin.alias("payload"))
    return inspect.activity(rows, NOW, 45)


def retention_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("namespace"), epoch_ms("ts").alias("ts"))
    return inspect.retained(rows, 40)


def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("namespace"), F.col("o_orderkey").alias("id"), epoch_ms("o_orderdate").alias("created_at"))
    return inspect.known_entities(rows, 100)


#: The fold in SQL, over sf (subject_id, predicate, seq, key, object, additive, multi).
_FOLD = """sr AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS rn FROM sf),
fold AS (
  SELECT subject_id, predicate, rn, seq, 'asserts' AS label, 'no_slot' AS route, []::BIGINT[] AS closed, [{'seq': seq, 'key': key, 'object': object}] AS now FROM sr WHERE rn = 1
  UNION ALL
  SELECT subject_id, predicate, rn, seq, label, CASE WHEN same THEN 'high_' || label ELSE 'low_' || label END, CASE WHEN label = 'supersedes' THEN list_transform(now, lambda f: f.seq) ELSE []::BIGINT[] END,
    CASE WHEN label = 'skip' THEN now WHEN label = 'supersedes' THEN [{'seq': seq, 'key': key, 'object': object}] ELSE list_append(now, {'seq': seq, 'key': key, 'object': object}) END
  FROM (
    SELECT s.*, f.now, len(list_filter(f.now, lambda x: x.object = s.object)) > 0 AS same, CASE
      WHEN s.key <> '' AND len(list_filter(f.now, lambda x: x.key = s.key)) > 0 THEN 'skip'
      WHEN len(list_filter(f.now, lambda x: x.object = s.object)) > 0 THEN CASE WHEN s.multi THEN 'extends' ELSE 'supersedes' END
      WHEN s.additive THEN 'extends' ELSE 'supersedes' END AS label
    FROM fold f JOIN sr s ON s.subject_id = f.subject_id AND s.predicate = f.predicate AND s.rn = f.rn + 1))"""
_SLOTS = f"""sf AS (
  SELECT user_id::VARCHAR AS subject_id, event_type AS predicate, event_id AS seq, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS key, json_extract_string(props, '$.k') AS object,
    event_id % 4 = 0 OR length(event_type) % 2 = 0 AS additive, length(event_type) % 2 = 0 AS multi FROM events),
{_FOLD}"""
QUERIES = {
    f.__name__: f
    for f in (
        slot_fold, slot_latest, supersession_pairs, spine_intervals, latest_per_slot, as_of_point, as_of_grid, tier_matrix, supersession_chain, superseded_in,
        touched_slots, ns_overview, top_predicates, entity_counts, facts_with_subject, list_facts_page, activity_summary, retention_cap, known_entities,
    )
}
_VISIBLE = "valid_at <= {0} AND (valid_to IS NULL OR valid_to > {0})"
ORACLES = {
    "slot_fold": f"WITH RECURSIVE {_SLOTS} SELECT seq, label, array_to_string(list_sort(closed), ',') AS closed FROM fold",
    "slot_latest": f"""WITH RECURSIVE {_SLOTS}, l AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY rn DESC) AS last FROM fold)
SELECT subject_id, predicate, len(now)::BIGINT AS n, list_max(list_transform(now, lambda f: f.seq)) AS newest FROM l WHERE last = 1""",
    "supersession_pairs": f"""WITH RECURSIVE {ROUTED},
sf AS (
  SELECT namespace || chr(1) || {NORMAL.format("subject_name")} AS subject_id, predicate, seq * 1000000 + CASE WHEN coref OR derives THEN 0 ELSE 500000 END + pos AS seq,
    {RESTATED.format("sentence")} AS key, object_literal AS object, predicate IN ({", ".join(f"'{m}'" for m in X.MULTIVALUED)}) AS multi, {WORD(X.ADDITIVE_CUES)} OR predicate IN ({", ".join(f"'{m}'" for m in X.MULTIVALUED)}) AS additive
  FROM ro),
{_FOLD}
SELECT string_split(subject_id, chr(1))[1]::BIGINT AS namespace, seq AS new_seq, route, unnest(closed) AS old_seq FROM fold WHERE label = 'supersedes'""",
    "spine_intervals": f"WITH {EVENTS} SELECT id, subject_id, predicate, valid_at, coalesce(valid_to, -1) AS valid_to, coalesce(superseded_by, -1) AS superseded_by, is_latest FROM ev",
    "latest_per_slot": """
SELECT o_custkey AS subject_id, o_orderpriority AS predicate, o_orderkey AS id, epoch_ms(o_orderdate) AS valid_at
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
    "as_of_point": f"WITH {EVENTS} SELECT id, subject_id, predicate, valid_at, coalesce(valid_to, -1) AS valid_to FROM ev WHERE {_VISIBLE.format(MID)}",
    "as_of_grid": f"WITH {EVENTS}, g AS (SELECT unnest({GRID}) AS t) SELECT predicate, t, count(*) AS visible FROM ev JOIN g ON {_VISIBLE.format('t')} GROUP BY ALL",
    "tier_matrix": f"""WITH {EVENTS}
SELECT 'default' AS surface, count(*) AS n FROM ev WHERE is_latest = 1 AND tier = 'hot' UNION ALL SELECT 'cold', count(*) FROM ev WHERE is_latest = 1
UNION ALL SELECT 'as_of_latest', count(*) FROM ev WHERE is_latest = 1 AND {_VISIBLE.format(MID)} UNION ALL SELECT 'as_of_history', count(*) FROM ev WHERE {_VISIBLE.format(MID)}
UNION ALL SELECT 'history', count(*) FROM ev""",
    "supersession_chain": f"""WITH RECURSIVE {EVENTS},
s AS (SELECT id FROM ev WHERE id NOT IN (SELECT superseded_by FROM ev WHERE superseded_by IS NOT NULL)),
fw AS (SELECT id AS start_id, id, 0::BIGINT AS step FROM s UNION ALL SELECT fw.start_id, e.superseded_by, fw.step + 1 FROM fw JOIN ev e ON e.id = fw.id WHERE e.superseded_by IS NOT NULL),
bw AS (SELECT id AS start_id, id, 0::BIGINT AS step FROM s UNION ALL SELECT bw.start_id, e.id, bw.step - 1 FROM bw JOIN ev e ON e.superseded_by = bw.id)
SELECT * FROM fw UNION ALL SELECT * FROM bw WHERE step < 0""",
    "superseded_in": f"WITH {EVENTS} SELECT id, superseded_by FROM ev WHERE superseded_by IN (SELECT id FROM ev WHERE tier = 'cold')",
    "touched_slots": f"WITH {EVENTS} SELECT DISTINCT subject_id, predicate FROM ev WHERE valid_at > {MID}",
    "ns_overview": f"""WITH {EVENTS} SELECT namespace, count_if(is_latest = 1)::BIGINT AS facts_latest, count_if(is_latest = 0)::BIGINT AS facts_retired,
  count(superseded_by) AS chains, round(count_if(is_latest = 0) / count(*), 6) AS supersession_rate FROM ev GROUP BY namespace""",
    "top_predicates": f"""WITH {EVENTS}, c AS (SELECT namespace, predicate, count(*) AS n FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY n DESC, predicate) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""",
    "entity_counts": "SELECT c_custkey AS id, any_value(c_name) AS name, count(o_orderkey) AS fact_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "facts_with_subject": "SELECT o_orderkey AS fact_id, o_custkey AS subject_id, o_orderstatus AS predicate, c_name AS subject_name FROM orders JOIN customer ON c_custkey = o_custkey",
    "list_facts_page": f"WITH {EVENTS} SELECT id, subject_id, predicate, fact_text, salience FROM ev WHERE is_latest = 1 AND salience >= 3.0 ORDER BY valid_at DESC, id DESC LIMIT 25 OFFSET 25",
    "activity_summary": f"""
WITH e AS (SELECT user_id % 10 AS namespace, epoch_ms(ts) AS ts, event_id % 2 = 0 AS is_add, event_id % 10 = 0 AS ui FROM events)
SELECT namespace, count_if(is_add AND NOT ui AND ts >= {NOW - 45 * 24 * HOUR})::BIGINT AS adds, count_if(NOT is_add AND NOT ui AND ts >= {NOW - 45 * 24 * HOUR})::BIGINT AS searches, min(ts) AS earliest_ts
FROM e GROUP BY namespace""",
    "retention_cap": """
SELECT id, namespace, ts FROM (SELECT event_id AS id, user_id % 10 AS namespace, epoch_ms(ts) AS ts, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 40""",
    "known_entities": """
SELECT namespace, id, created_at FROM (SELECT o_custkey % 7 AS namespace, o_orderkey AS id, epoch_ms(o_orderdate) AS created_at, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 100""",
}

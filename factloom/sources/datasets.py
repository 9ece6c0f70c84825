"""Readers of conversation datasets: JSON files to turns and questions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import extract
from factloom.operators.evaluate import nearest_rank

#: Categories of the conversation dataset's questions.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}
TURN_STEP_MS = 1_000
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def parse_session_date(text: Column) -> Column:
    """'2023/04/10 (Mon) 23:07' to milliseconds, UTC."""
    bare = F.trim(F.regexp_replace(text, r"\s*\([^)]*\)", ""))
    return F.unix_millis(F.to_timestamp(bare, "yyyy/MM/dd HH:mm"))


def parse_spoken_date(text: Column) -> Column:
    """'1:56 pm on 8 May, 2023' to milliseconds, UTC."""
    bare = F.upper(F.regexp_replace(text, r"\s+on\s+", " "))
    proper = F.regexp_replace(bare, ",", "")
    parts = F.regexp_extract_all(proper, F.lit(r"\S+"), F.lit(0))
    rebuilt = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.initcap(F.lower(F.get(parts, F.lit(3)))), F.get(parts, F.lit(4)))
    return F.unix_millis(F.to_timestamp(rebuilt, "h:mm a d MMMM yyyy"))


_TURNS = "array<struct<role:string,content:string>>"


def read_sessions(spark: SparkSession, path: str, slice: str = "all") -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of entries with haystack sessions, in either shape: turn lists, or objects with turns.

    A dateless session comes an hour after the one before it; where none has a date, sessions start a day each before
    the question. Sessions are in order of time, turns a second apart.
    """
    schema = "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    if slice == "ku":
        rows = rows.where("question_type = 'knowledge-update'")
    turns_of = lambda s: F.when(F.startswith(F.ltrim(s), F.lit("[")), F.from_json(s, _TURNS)).otherwise(F.from_json(s, f"turns {_TURNS}")["turns"])
    first = parse_session_date(F.col("question_date")) - DAY_MS * F.size("haystack_sessions")
    dated = F.transform(F.sequence(F.lit(0), F.size("haystack_sessions") - 1), lambda i: parse_session_date(F.get(F.col("haystack_dates"), i)))

    def next_start(acc: Column, t: Column) -> Column:
        previous = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.coalesce(t, previous + HOUR_MS, first)))

    starts = F.aggregate(dated, F.array().cast("array<bigint>"), next_start)
    sessions = rows.withColumn("t0", starts).select(
        F.col("question_id").alias("namespace"), F.posexplode(F.arrays_zip("t0", "haystack_sessions")).alias("session", "x")
    )
    turns = sessions.select("namespace", "session", F.col("x.t0").alias("t0"), F.posexplode(turns_of(F.col("x.haystack_sessions"))).alias("pos", "turn"))
    turns = turns.select(
        "namespace", "session", "pos", F.col("turn.content").alias("raw"), F.col("turn.role").alias("source"), (F.col("t0") + F.col("pos") * TURN_STEP_MS).alias("t_ref")
    )
    questions = rows.select(
        "question_id", "question_type", "question", F.col("answer").alias("gold"), F.coalesce("question_date", F.lit("")).alias("question_date"), F.endswith("question_id", F.lit("_abs")).alias("is_abstention")
    )
    return turns, questions


def read_dialogues(spark: SparkSession, path: str, slice: str = "all") -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of conversations with numbered sessions and categorised questions."""
    rows = spark.read.schema("sample_id string, qa array<struct<question:string,answer:string,adversarial_answer:string,category:int>>, conversation string").option("multiLine", True).json(path)
    parts = rows.select(F.col("sample_id").alias("namespace"), F.explode(F.from_json("conversation", "map<string,string>")).alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    sessions = parts.where(number != "").select("namespace", number.cast("int").alias("session"), F.from_json("value", "array<struct<speaker:string,text:string,blip_caption:string>>").alias("turns"))
    dates = parts.where(F.col("key").rlike(r"^session_\d+_date_time$")).select(
        "namespace", F.regexp_extract("key", r"(\d+)", 1).cast("int").alias("session"), parse_spoken_date(F.col("value")).alias("t0")
    )
    turns = sessions.join(dates, ["namespace", "session"]).select("namespace", "session", "t0", F.posexplode("turns").alias("pos", "t"))
    said = F.concat(F.col("t.speaker"), F.lit(": "), F.col("t.text"))
    shown = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.lit("\n"), F.col("t.speaker"), F.lit(" shared a photo: "), F.col("t.blip_caption"))).otherwise("")
    turns = turns.select("namespace", "session", "pos", F.concat(said, shown).alias("raw"), F.col("t.speaker").alias("source"), (F.col("t0") + F.col("pos") * TURN_STEP_MS).alias("t_ref"))
    wanted = [2] if slice == "temporal" else [1, 2, 3, 4]
    names = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    qa = rows.select("sample_id", F.posexplode("qa").alias("pos", "q")).where(F.col("q.category").isin(*wanted))
    questions = qa.select(
        F.concat(F.col("sample_id"), F.lit("_q"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("question_id"),
        names[F.col("q.category")].alias("question_type"),
        F.col("q.question").alias("question"),
        F.coalesce("q.answer", "q.adversarial_answer", F.lit("")).alias("gold"),
        F.col("q.category").alias("category"),
    )
    return turns, questions


def ingest_units(memory, turns: DataFrame, engine: str, at_once: int = 50, limit: int | None = None) -> DataFrame:
    """Ingest namespaces of turns (namespace, raw, source, t_ref) that aren't done, some at once; the manifest.

    A namespace that an earlier run left in parts is removed first. The manifest has a row for each namespace that is
    done: its turns, facts, supersessions and escalations, and the milliseconds a turn took in its batch, of which
    `timing` makes percentiles. One that another engine wrote is refused.
    """
    store, spark = memory.store, memory.spark
    path = f"{store.root}/_manifest"
    schema = "namespace string, engine string, turns long, facts long, supersessions long, seen long, escalated long, add_ms double"
    kept = spark.read.schema(schema).json(path) if store._fs.exists(store._path("_manifest")) else spark.createDataFrame([], schema)
    if not kept.where(F.col("engine") != engine).isEmpty():
        raise ValueError(f"{store.root} was built by another engine than {engine}")
    todo = [r["namespace"] for r in pending(turns.select("namespace").distinct(), kept, "namespace").orderBy("namespace").limit(limit or 1_000_000).collect()]
    for a in range(0, len(todo), at_once):
        names = todo[a : a + at_once]
        mine = F.col("namespace").isin(*names)
        for r in store.read("episode").where(mine).select("namespace").distinct().collect():
            store.clear(r["namespace"])
        batch = turns.where(mine)
        began = time.perf_counter()
        memory.add_batch(batch)
        n = batch.groupBy("namespace").agg(F.count(F.lit(1)).alias("turns"))
        took = 1000 * (time.perf_counter() - began) / max(1, batch.count())
        routed = extract.route(extract.candidates(batch)).groupBy("namespace").agg(F.count(F.lit(1)).alias("seen"), F.count_if("escalated").alias("escalated"))
        facts = memory.facts().where(mine).groupBy("namespace").agg(F.count(F.lit(1)).alias("facts"), F.count("superseded_by").alias("supersessions"))
        rows = n.join(routed, "namespace", "left").join(facts, "namespace", "left").na.fill(0).withColumns({"engine": F.lit(engine), "add_ms": F.lit(took)})
        rows.select(*[c.split()[0] for c in schema.split(", ")]).coalesce(1).write.mode("append").json(path)
    return spark.read.schema(schema).json(path) if store._fs.exists(store._path("_manifest")) else kept


def timing(manifest: DataFrame) -> DataFrame:
    """The 50th and 95th percentile of the milliseconds a turn took, by nearest rank."""
    half, most = (nearest_rank(manifest, "add_ms", p).select(F.round("value", 2).alias(f"add_ms_p{round(100 * p)}")) for p in (0.5, 0.95))
    return half.join(F.broadcast(most))  # two single rows


def pending(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose key isn't in the done set: what a resumed job still has to do."""
    return units.join(done.select(key).distinct(), key, "left_anti")

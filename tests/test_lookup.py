"""Lookups, events, upgrades, plug-ins and clearing."""

import pytest
from pyspark.sql import functions as F

from factloom.memory import Memory
from factloom.operators import lookup, plugins, retrieve
from factloom.sources import events, migrate
from factloom.sources.store import LeaseHeld


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    out = Memory(spark, f"file://{tmp_path_factory.mktemp('lookup')}")
    rows = [("a", "I work at Acme.", 1000, "user"), ("b", "Bob likes tea.", 1000, "user")]
    schema = "namespace string, raw string, t_ref long, source string"
    out.add_batch(spark.createDataFrame(rows, schema))
    out.add_batch(spark.createDataFrame([("a", "I work at Zorbex now.", 2000, "user")], schema))
    return out


def test_lookups(memory):
    facts, entities, episodes = memory.facts(), memory.entities(), memory.store.read("episode")
    old = facts.where("fact_text LIKE '%Acme%'").first()
    fact, chain, episode = lookup.fact_detail(facts, entities, episodes, old["id"])
    assert fact.count() == 1 and {r["fact_count"] for r in memory.entity_counts().collect()} == {1, 2}
    assert fact.first()["subject_name"] == "user" and [r["step"] for r in chain.collect()] == [0, 1] and episode.first()["raw"] == "I work at Acme."
    assert lookup.latest_in_slot(facts, old["subject_id"], "works_at").count() == 1
    assert lookup.latest_after(facts, old["seq"]).count() == 1 + (facts.where("namespace = 'b'").first()["seq"] > old["seq"])
    assert lookup.slots_touched(facts).count() == 2 and lookup.embedding_of(facts, old["id"]).first()["embedding"]
    assert lookup.hydrate(facts, facts.select("id").limit(1)).count() == 1
    assert lookup.list_episodes(episodes, page_size=2).count() == 2
    assert lookup.episode_facts(episodes, facts, old["episode_id"]).count() == 1
    assert lookup.retired_values(facts, "acme", "zorbex").count() == 1


def test_rerank_by_a_model(memory):
    facts = memory.facts().where("namespace = 'a'")
    fused = facts.select("id", F.row_number().over(F_window()).alias("fused_rank"))
    scored = retrieve.rerank(fused, facts, "q", lambda q, texts: [len(t) for t in texts])
    assert {r["relevance_raw"] for r in scored.collect()} == {15.0, 21.0}


def F_window():
    from pyspark.sql import Window

    return Window.orderBy("id")


def test_events(spark, memory, tmp_path):
    log = events.EventLog(memory.store, keep=2)
    for i in range(3):
        assert log.record("a", "add" if i else "search", 1000 + i, 1.5, {"origin": "ui" if i == 1 else "api"})
    assert log.events().count() == 2 and [r["ts"] for r in log.page("a", page_size=1).collect()] == [1002]
    assert log.activity(1100).first()["adds"] == 1
    assert not log.record("a", "add", 1, "x", {})
    assert events.done(spark, f"{tmp_path}/none", "id").count() == 0
    events.append_lines(spark.createDataFrame([("x",)], "id string"), f"{tmp_path}/lines")
    assert events.done(spark, f"{tmp_path}/lines", "id").first()["id"] == "x"


def test_upgrade(spark):
    facts, entities = spark.createDataFrame([("f", 2.0)], "id string, salience double"), spark.createDataFrame([("e", "ACME")], "id string, name string")
    facts, entities = migrate.upgrade(facts, entities, 1)
    assert facts.first()["tier"] == "hot" and entities.first()["name_key"] == "acme"
    with pytest.raises(ValueError):
        migrate.upgrade(facts, entities, 9)


def test_models_plug_in(spark):
    episodes = spark.createDataFrame([(1, "Hi. Bob likes tea. Bye.")], "seq int, raw string")
    make = lambda: lambda texts: [[("Bob", "likes", "tea", 0.9, 4, 7), ("x", "y", "z", 0.1, 0, 1)] for _ in texts]
    found = plugins.generate(episodes, make)
    assert [(r["subject_name"], r["sentence"]) for r in found.collect()] == [("Bob", "Bob likes tea")]

    def fails(sentences):
        raise RuntimeError

    assert plugins.typed_by(found, lambda s: ["derives"] * len(s), F.lit("asserts")).first()["relation"] == "derives"
    assert plugins.typed_by(found, fails, F.lit("asserts")).first()["relation"] == "asserts"


def test_leases_and_clearing(memory):
    with memory.store.lease():
        memory.store.heartbeat()
        with pytest.raises(LeaseHeld):
            memory.store.clear("b")
        with memory.store.lease(stale_s=-1):
            pass
    memory.store.clear("b")
    assert {r["namespace"] for r in memory.facts().collect()} == {"a"} and memory.facts().where("is_latest = 0").count() == 1

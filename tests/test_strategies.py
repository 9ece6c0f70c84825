"""Models in place of the deterministic steps, and resumed ingestion."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.embed import FakeEmbedder
from factloom.memory import Memory
from factloom.operators import extract, maintain, plugins
from factloom.sources import datasets

T0 = 1_000_000_000_000


class Shouting:
    backend_id = "shouting"

    def __call__(self, texts):
        return [" / ".join(t).upper() for t in texts]


def test_every_step_can_be_replaced(spark, tmp_path):
    def generate(episodes):
        return extract.candidates(episodes).withColumn("predicate", F.lit(""))

    steps = plugins.Strategies(
        generate=generate, route=lambda found: extract.route(found, threshold=2.0), typed=lambda routed: extract.typed(routed).withColumn("salience", F.lit(9.0)),
        rerank=lambda query, texts: [float("Rome" in t) for t in texts], summarize=Shouting(),
    )
    config = maintain.Config(tau_near=1.1, min_cluster=2, age_floor_days=1)
    memory = Memory(spark, f"file://{tmp_path}", FakeEmbedder(8, 4), config, steps)
    memory.add_batch(spark.createDataFrame([("n", f"I also visited and like {c}.", T0 + i, "user") for i, c in enumerate(("Oslo", "Rome", "Bern"))], "namespace string, raw string, t_ref long, source string"))
    facts = memory.history("n").collect()
    assert {f["predicate"] for f in facts} == {"about"} and {f["salience"] for f in facts} == {9.0}
    assert "Rome" in memory.search("n", "where?", now=T0 + 9, touch=False).first()["fact_text"]
    memory.maintain("n", now=T0 + 40 * 86_400_000)
    payload = memory.proposals("n", T0 + 40 * 86_400_000).where("kind = 'summarize'").first()
    assert "LIKE ROME" in payload["payload_json"] and payload["evidence_backend"] == "shouting"


def test_relations_are_as_sure_as_their_ends(spark):
    relations = spark.createDataFrame([(1, "Ann", "Acme", 0.9), (1, "Bob", "Acme", 0.5), (2, "Ann", "Acme", 0.8)], "e long, subject_name string, object_literal string, confidence double")
    entities = spark.createDataFrame([(1, "Ann", 0.7), (1, "Ann", 0.6), (1, "Acme", 0.95)], "e long, name string, confidence double")
    found = {(r["e"], r["subject_name"]): (r["confidence"], r["grounded"]) for r in plugins.combined(relations, entities, ["e"]).collect()}
    assert found == {(1, "Ann"): (0.7, True), (1, "Bob"): (0.5, False), (2, "Ann"): (0.8, False)}


def test_subjects_get_the_known_spelling(spark):
    known = spark.createDataFrame([("n", "anna maria", "Anna Maria")], "namespace string, name_key string, name string")
    rows = spark.createDataFrame([("n", "ANNA  maria"), ("n", "Bob"), ("m", "ANNA  maria")], "namespace string, subject_name string")
    assert sorted((r["namespace"], r["subject_name"]) for r in plugins.canonical(rows, known).collect()) == [("m", "ANNA  maria"), ("n", "Anna Maria"), ("n", "Bob")]


def test_judges_run_in_batches(spark):
    rows = spark.createDataFrame([("a", "a b"), ("c", "a b")], "gold string, hypothesis string")
    assert [r["label"] for r in plugins.judged_by(rows, lambda g, h: [x in y for x, y in zip(g, h, strict=True)]).collect()] == [True, False]


def test_ingestion_resumes(spark, tmp_path):
    turns = spark.createDataFrame([(n, f"I like {w}.", "user", T0 + i) for n in "abc" for i, w in enumerate(("tea", "jazz"))], "namespace string, raw string, source string, t_ref long")
    memory = Memory(spark, f"file://{tmp_path}")
    assert datasets.ingest_units(memory, turns, "own", at_once=1, limit=1).count() == 1
    memory.add("b", "I like a part of an earlier run.", T0)  # not in the manifest, so it goes
    done = datasets.ingest_units(memory, turns, "own")
    assert {(r["namespace"], r["turns"], r["facts"]) for r in done.collect()} == {(n, 2, 2) for n in "abc"}
    assert memory.history("b").count() == 2 and memory.store.read("episode").count() == 6
    assert datasets.timing(done).first()["add_ms_p95"] > 0
    with pytest.raises(ValueError, match="another engine"):
        datasets.ingest_units(memory, turns, "other")

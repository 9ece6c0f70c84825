"""Maintenance leaves the past as it was; proposals are decided once."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.embed import FakeEmbedder
from factloom.memory import Memory
from factloom.operators import maintain

NOW, DAY = 2_000_000_000_000, 86_400_000


def fact(seq, predicate, text, days, access=0, salience=4.0, last=None):
    return (f"f{seq:03d}", seq, "n", "user", predicate, text.split()[-1], text, "e", NOW - days * DAY, NOW - days * DAY, 0.9, salience, 0, "fact", [float(seq % 7), 1.0], [1.0])


@pytest.fixture
def memory(spark, tmp_path):
    out = Memory(spark, f"file://{tmp_path}", config=maintain.Config(tau_near=0.999))
    rows = [
        fact(1, "works_at", "works at acme", 500), fact(2, "works_at", "works at globex", 300),
        fact(3, "likes", "likes jazz", 400), fact(4, "likes", "LIKES  jazz", 450), fact(5, "likes", "likes blues", 420),
        fact(6, "notes", "trivial ancient note", 300, salience=1.0),
    ]
    store = out.store
    store.append("fact_assert", spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in store.read("fact_assert").schema)))
    events = [(7, "f001", "supersede", NOW - 300 * DAY, "f002", None), (8, "f003", "touch", NOW - 350 * DAY, None, None), (9, "f005", "touch", NOW - 300 * DAY, None, None)]
    store.append("fact_event", spark.createDataFrame(events, "seq long, fact_id string, kind string, at_ms long, ref_id string, val string"))
    return out


def visible(memory):
    grid = [NOW - d * DAY for d in (480, 460, 430, 410, 350, 250, 100, 1)]
    return [{r["id"] for r in memory.history("n", as_of=t).select("id").collect()} for t in grid]


def test_run_keeps_the_past(memory):
    before = visible(memory)
    assert memory.maintain("n", now=NOW, dry_run=True)["merges"] == 1
    counts = memory.maintain("n", now=NOW)
    assert counts["merges"] == 1 and counts["demotions"] == 1
    assert visible(memory) == before
    facts = {f["id"]: f for f in memory.history("n").collect()}
    assert facts["f003"]["superseded_by"] == "f004" and not facts["f003"]["is_latest"] and facts["f003"]["valid_to"] is None
    assert facts["f006"]["tier"] == "cold" and facts["f004"]["access_count"] == 1
    assert memory.status(NOW).first()["is_stale"] is False and memory.status(NOW + 8 * DAY).first()["is_stale"] is True


def test_superseding_a_survivor_closes_its_duplicates(memory):
    memory.maintain("n", now=NOW)
    events = memory.spark.createDataFrame([("f004", "f999", NOW + 5)], "fact_id string, by_id string, at_ms long")
    from factloom.operators.spine import closing_events

    found = {(e["fact_id"], e["kind"], e["at_ms"]) for e in closing_events(events, memory.facts(), memory.store.read("fact_derivation")).collect()}
    assert found == {("f004", "supersede", NOW + 5), ("f003", "cascade_close", NOW + 5)}


def test_first_decision_wins(memory):
    memory.config = maintain.Config(tau_near=0.7)
    memory.maintain("n", now=NOW)
    queue = memory.proposals("n", NOW)
    near = queue.where("kind = 'dedup_near'").first()
    assert near is not None and memory.review_queue("n", now=NOW).count() >= 1
    assert memory.decide("n", "nothing", "approve", NOW) == "not_found"
    assert memory.decide("n", near["id"], "approve", NOW) in ("approved", "stale_target")
    assert memory.decide("n", near["id"], "reject", NOW) != "rejected"
    assert memory.proposals("n", NOW + 31 * DAY).where("status = 'pending'").count() == 0
    with pytest.raises(ValueError):
        memory.decide("n", near["id"], "maybe", NOW)


def test_near_pairs_in_blocks_equal_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 3))
    rows = [(i, int(i % 2), i % 5, v[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, valid_at long, embedding array<double>")
    monkeypatch.setattr(maintain, "BLOCK", 7)
    found = {(r["a"], r["b"]) for r in maintain.near_pairs(df, 0.9, slot=["label"], text=None).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    key = lambda i: (i % 5, i)
    expected = {(i, j) for i in range(60) for j in range(60) if i % 2 == j % 2 and key(i) < key(j) and round(float(u[i] @ u[j]), 6) >= 0.9}
    assert found == expected and expected


def test_near_pairs_round_as_their_sql(spark, tmp_path):
    from factloom.plans import maintenance
    from tests.oracle import assert_same

    cosines = [0.33795, 0.35505, 0.30365, 0.2999997, 0.2999994, -0.33795]  # halves, and what rounds to the threshold or not quite
    rows = [(2 * i + j, v, i) for i, c in enumerate(cosines) for j, v in enumerate([[1.0, 0.0], [c, (1 - c * c) ** 0.5]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = maintenance.dedup_near(spark, str(tmp_path))
    assert {r["label"]: r["cosine"] for r in found.collect()} == {0: 0.3379, 1: 0.355, 2: 0.3036, 3: 0.3}
    assert_same(found, maintenance.ORACLES["dedup_near"], tmp_path)


def test_near_pairs_of_nulls_as_their_sql(spark, tmp_path):
    from factloom.plans import maintenance
    from tests.oracle import assert_same

    rows = [(1, [1.0, 0.0], None), (2, [1.0, 0.0], None), (None, [1.0, 0.0], 7), (3, [1.0, 0.0], 7), (4, None, 7), (5, [1.0, 1.0], 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert_same(maintenance.dedup_near(spark, str(tmp_path)), maintenance.ORACLES["dedup_near"], tmp_path)


def test_summary_is_never_backdated(spark, tmp_path):
    memory = Memory(spark, f"file://{tmp_path}", embedder=FakeEmbedder(2, 1), config=maintain.Config(tau_near=1.1))
    rows = [fact(i, "likes", f"likes thing{i}", 200 + i, salience=5.0) for i in range(1, 7)]
    memory.store.append("fact_assert", spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in memory.store.read("fact_assert").schema)))
    assert memory.maintain("n", now=NOW)["summarize"] == 1
    proposal = memory.proposals("n", NOW).first()
    with pytest.raises(ValueError, match="dimensions"):
        Memory(spark, f"file://{tmp_path}", config=memory.config).decide("n", proposal["id"], "approve", NOW)
    assert memory.decide("n", proposal["id"], "approve", NOW) == "approved"
    facts = memory.history("n").collect()
    summary = [f for f in facts if f["record_kind"] == "summary"]
    assert len(summary) == 1 and summary[0]["valid_at"] == NOW and summary[0]["fact_text"].startswith("Summary (extractive): ")
    assert {f["tier"] for f in facts if f["record_kind"] == "fact"} == {"cold"}
    assert memory.history("n", as_of=NOW - 1).where(F.col("record_kind") == "summary").count() == 0


def test_a_second_run_proposes_nothing_twice(memory):
    memory.config = maintain.Config(tau_near=0.7, min_cluster=2, age_floor_days=1)
    first = memory.maintain("n", now=NOW)
    assert first["dedup_near"] + first["summarize"] + first["evict"] > 0
    staged = memory.proposals("n", NOW).count()
    assert memory.maintain("n", now=NOW + DAY) == {"below_threshold": 1}
    second = memory.maintain("n", now=NOW + DAY, force=True)
    assert second["dedup_near"] == second["summarize"] == second["evict"] == 0 and memory.proposals("n", NOW).count() == staged
    assert memory.maintain("n", now=NOW + 9 * DAY, dry_run=True)["dropped"] == 0
    ledger = [(r["status"], r["cursor"]) for r in memory.store.read("maintenance_run").collect()]
    assert len(ledger) == 3 and {c for _, c in ledger} == {ledger[0][1]}
    assert memory.status(NOW).first()["pending"] == staged


def test_a_budget_tells_what_it_drops(memory):
    memory.config = maintain.Config(tau_near=0.0, budget=1)
    counts = memory.maintain("n", now=NOW, dry_run=True)
    assert counts["dedup_near"] == 1 and counts["dropped"] >= 1


def test_edit_and_promote(memory, spark):
    memory.embedder = FakeEmbedder(2, 1)
    memory.config = maintain.Config(tau_near=1.1, min_cluster=2, age_floor_days=1, evict_threshold=0.5, auto_salience=0.0)
    memory.maintain("n", now=NOW)
    queue = {p["kind"]: p["id"] for p in memory.proposals("n", NOW).collect()}
    assert {"summarize", "evict"} <= set(queue)
    assert memory.decide("n", queue["summarize"], "promote", NOW) == memory.decide("n", queue["evict"], "edit", NOW, "x") == "invalid_decision"
    assert memory.decide("n", queue["evict"], "promote", NOW) == "promoted" and memory.decide("n", queue["evict"], "approve", NOW) == "rejected"
    assert memory.decide("n", queue["summarize"], "edit", NOW, "in own words") == "edited"
    facts = {f["fact_text"]: f for f in memory.history("n").collect()}
    assert facts["in own words"]["record_kind"] == "summary"
    cold = next(f["id"] for f in facts.values() if f["tier"] == "cold")
    assert memory.promote("n", cold, NOW) == "promoted" and memory.promote("n", "nothing", NOW) == "not_found"
    assert memory.history("n").where(F.col("id") == cold).first()["tier"] == "hot"
    assert memory.store.read("episode").where("source = 'maintenance'").count() == 1


def test_duplicates_point_at_live_facts(spark):
    """b was merged into a; then a is merged into d: b points at d. A survivor that was merged already stands for its canonical."""
    from factloom.operators import lifecycle

    facts = spark.createDataFrame([("a", 1, None, None), ("b", 0, "a", None), ("c", 0, "a", 5), ("d", 1, None, None), ("e", 1, None, None)], "id string, is_latest int, superseded_by string, valid_to long")
    merges = spark.createDataFrame([("d", ["a"]), ("b", ["e", "a"])], "survivor_id string, loser_ids array<string>")
    found = lifecycle.canonical_merges(merges, facts)
    assert sorted((r["survivor_id"], r["loser_ids"]) for r in found.collect()) == [("a", ["e"]), ("d", ["a"])]
    assert [(r["fact_id"], r["ref_id"]) for r in lifecycle.repoint_events(found.where("survivor_id = 'd'"), facts, 9).collect()] == [("b", "d")]


def test_a_unit_of_work_is_seen_whole_or_not_at_all(spark, tmp_path):
    from factloom.sources.store import LeaseHeld, Store

    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    row = spark.createDataFrame([("a", "n")], "id string, namespace string")
    with pytest.raises(KeyError):
        with store.unit("one"):
            store.append("episode", row)
            raise KeyError
    assert store.read("episode").count() == 0
    with store.unit("one") as fresh:
        store.append("episode", row)
        assert fresh and other.read("episode").count() == 0
        with pytest.raises(RuntimeError):
            with store.unit():
                pass
        with pytest.raises(LeaseHeld):
            with other.unit():
                pass
    with other.unit("one") as fresh:
        assert not fresh
    assert other.read("episode").count() == 1
    # a writer lost between commit and move: the next one moves what it left
    row.write.parquet(f"file://{tmp_path}/_units/lost/episode")
    (tmp_path / "_units/lost/_COMMITTED").touch()
    row.write.parquet(f"file://{tmp_path}/_units/open/episode")
    with other.unit():
        pass
    assert other.read("episode").count() == 2


def test_a_table_left_between_two_renames_comes_back(spark, tmp_path):
    from factloom.sources.store import Store

    store = Store(spark, f"file://{tmp_path}")
    store.append("episode", spark.createDataFrame([("a", "n"), ("b", "m")], "id string, namespace string"))
    store.clear("m")
    assert [r["id"] for r in store.read("episode").collect()] == ["a"] and not (tmp_path / "_before").exists()
    (tmp_path / "_before").mkdir()
    (tmp_path / "episode").rename(tmp_path / "_before/episode")
    with store.unit():
        pass
    assert store.read("episode").count() == 1


def test_a_writer_taken_over_leaves_its_successors_lease(spark, tmp_path):
    from factloom.sources.store import LeaseHeld, Store

    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    with store.lease():
        store.heartbeat()
        with other.lease(stale_s=-1):
            with pytest.raises(LeaseHeld):
                store.heartbeat()
            assert other.holds() and not store.holds()

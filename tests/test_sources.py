"""Dataset readers and streams."""

import json

from factloom.memory import Memory
from factloom.operators.evaluate import parse_label, truncate_gold
from factloom.sources import datasets
from factloom.streaming import ingest


def ms(text):
    from datetime import UTC, datetime

    return int(datetime.strptime(text, "%Y-%m-%d %H:%M").replace(tzinfo=UTC).timestamp() * 1000)


def test_sessions(spark, tmp_path):
    turn = lambda t: {"role": "user", "content": t}
    rows = [
        {"question_id": "q1_abs", "question_type": "knowledge-update", "question": "?", "answer": 3, "question_date": "2023/05/01 (Mon) 10:00",
         "haystack_dates": ["2023/04/10 (Mon) 23:07", None], "haystack_sessions": [[turn("a"), turn("b")], {"session_id": "s", "turns": [turn("c")]}]},
        {"question_id": "q2", "question_type": "other", "question": "?", "answer": "x", "question_date": "2023/05/01 (Mon) 10:00", "haystack_dates": [], "haystack_sessions": [[turn("d")]]},
    ]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    turns, questions = datasets.read_sessions(spark, str(tmp_path / "f.json"))
    start = ms("2023-04-10 23:07")
    assert {(r["raw"], r["t_ref"]) for r in turns.collect()} == {("a", start), ("b", start + 1000), ("c", start + 3_600_000), ("d", ms("2023-04-30 10:00"))}
    assert {(r["question_id"], r["gold"], r["is_abstention"]) for r in questions.collect()} == {("q1_abs", "3", True), ("q2", "x", False)}
    assert datasets.read_sessions(spark, str(tmp_path / "f.json"), "ku")[1].count() == 1


def test_dialogues(spark, tmp_path):
    rows = [{
        "sample_id": "c1",
        "qa": [{"question": "?", "answer": "y", "category": 2, "evidence": []}, {"question": "?", "adversarial_answer": "n", "category": 5}, {"question": "?", "answer": 7, "category": 1}],
        "conversation": {"speaker_a": "A", "speaker_b": "B", "session_2_date_time": "1:56 pm on 8 May, 2023", "session_2": [{"speaker": "A", "dia_id": "1", "text": "hi", "blip_caption": "a cat"}],
                         "session_10_date_time": "12:05 am on 9 May, 2023", "session_10": [{"speaker": "B", "dia_id": "2", "text": "yo"}]},
    }]
    (tmp_path / "g.json").write_text(json.dumps(rows))
    turns, questions = datasets.read_dialogues(spark, str(tmp_path / "g.json"))
    assert [(r["session"], r["raw"], r["t_ref"]) for r in turns.orderBy("session").collect()] == [(2, "A: hi\nA shared a photo: a cat", ms("2023-05-08 13:56")), (10, "B: yo", ms("2023-05-09 00:05"))]
    assert {(r["question_id"], r["question_type"], r["gold"]) for r in questions.collect()} == {("c1_q000", "temporal", "y"), ("c1_q002", "multi-hop", "7")}


def test_pending(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x",), ("x",)], "id string")
    assert [r["id"] for r in datasets.pending(a, b, "id").collect()] == ["y"]


def test_labels(spark):
    df = spark.createDataFrame([('{"label": "correct"}', 3, "a; b"), ("it is WRONG", 1, "a; b"), ("INCORRECT", 3, "a"), ("CORRECT or WRONG", 3, "a")], "o string, c int, g string")
    assert [r[0] for r in df.select(parse_label(df["o"])).collect()] == [True, False, None, None]
    assert [r[0] for r in df.select(truncate_gold(df["c"], df["g"])).collect()] == ["a", "a; b", "a", "a"]


def test_stream_of_episodes(spark, tmp_path):
    rows = [("s", "I work at Acme.", 1000, "user"), ("s", "I work at Zorbex now.", 2000, "user")]
    schema = "namespace string, raw string, t_ref long, source string"
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    memory = Memory(spark, f"file://{tmp_path}/store")
    run = lambda: ingest.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), memory, f"{tmp_path}/ck").awaitTermination()
    run()
    spark.createDataFrame(rows[1:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert [f["object_literal"] for f in memory.facts().where("is_latest = 1").collect()] == ["Zorbex"]
    # a batch that is replayed finds its mark, which was committed with its rows
    marks = sorted(p.name for p in (tmp_path / "store" / "_marks").iterdir() if not p.name.startswith("."))
    assert len(marks) == 2 and memory.add_batch(spark.createDataFrame(rows, schema), mark=marks[0]).count() == 0
    assert memory.store.read("episode").count() == 2


def test_episodes_of_one_time_are_taken_as_they_arrive(spark, tmp_path):
    names = ["Acme", "Zorbex", "Initech", "Globex", "Hooli"]
    rows = [("s", f"I work at {n}.", 1000, "user", i) for i, n in enumerate(names)]
    memory = Memory(spark, f"file://{tmp_path}")
    memory.add_batch(spark.createDataFrame(rows, "namespace string, raw string, t_ref long, source string, arrival long").repartition(3))
    assert [f["object_literal"] for f in memory.facts().where("is_latest = 1").collect()] == ["Hooli"]


def test_windowed_activity(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id, 0, 0) AS ts, 'add' AS kind FROM range(5)").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/ev")
    query = ingest.activity(stream).writeStream.format("memory").queryName("activity").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("activity").count() >= 3

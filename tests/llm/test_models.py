"""The classifier by held-out accuracy, top-k and license scans by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import classifier, licenses, topk
from tests.oracle import assert_same

DATA = "/root/testdata/sf0.001"


def test_op3_on_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    scored = classifier.quality_classifier(spark, data)
    assert scored.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_dual_descent_separates_and_bounds():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 10)) + (50 if i % 3 == 0 else 0) for i in range(90)]
    model = classifier.fit([r.astype(np.int64) for r in rows], [int(i % 3 == 0) for i in range(90)])
    assert all((model.score(r.astype(np.int64)) >= 0.5) == (i % 3 == 0) for i, r in enumerate(rows))


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 1.0), (2, None, 2.0), (3, "", 3.0), (3, "", 3.0), (None, "x " * 9000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (9, 1), (None, 1)], "doc_id long, quality int")
    model = classifier.learn(docs, labels, F.lit(True))
    out = classifier.score(docs, model, into="_score").collect()
    assert len(out) == 5 and all(0 <= r["_score"] <= 1 for r in out)
    assert classifier.score(docs.limit(0), classifier.fit([], []), into="s").count() == 0
    assert classifier.fit([], []).score(classifier.features("a b")) == 0.5


def test_shapes_and_runs():
    assert classifier.shape("Thhaen,") == "Aa," and classifier.shape("RE!!!!") == "A!!" and classifier.shape("x12") == "a0"
    assert len(classifier.features("a a a a")) > len(classifier.features("a b c d")) - 6
    assert not len(classifier.features(None))


def test_op4_equals_sql(spark):
    assert_same(topk.exact_top_k(spark, DATA), topk.ORACLES["op4_exact_top_k"])


@pytest.mark.parametrize("box_bytes", [1 << 20, 0])
def test_top_k_by_brute_force(spark, monkeypatch, box_bytes):
    monkeypatch.setattr(topk, "BOX_BYTES", box_bytes)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.1, 4).round(2).tolist()) for i in range(300)] + [(300 + i, [0.1, 0.1, 0.1, 0.1]) for i in range(150)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, []), (None, [1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0]), (910, [3.0, 1.0])]
    odd += [(5, vectors[5][1]), (20, vectors[20][1]), (20, vectors[20][1]), (20, [0.9, 0.9, 0.9, 0.9]), (30, [0.5, 0.5, 0.5, 0.5])]  # repeated rows, and ids of two vectors
    df = spark.createDataFrame([(*v, "x") for v in vectors + odd], "vec_id long, embedding array<double>, rank string")
    found = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard=64, block=16).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors + odd if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = {}
    for n, (q, v) in enumerate(usable):
        if q % 10 == 0:
            scores = sorted((-int(v @ w), i) for m, (i, w) in enumerate(usable) if m != n and len(v) == len(w))[:5]
            expected.setdefault(q, []).extend((rank + 1, i, -s) for rank, (s, i) in enumerate(scores))
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in expected.items() if x}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_far_shards_are_left_out(spark):
    """Vectors of two opposite clusters: no query is sent to a shard of the other one."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 0.01, 6) + (1 if i % 2 else -1)).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, [int(256 * x) for x in v], True, 6) for i, v in rows], "id long, v array<bigint>, q boolean, dim int")
    dealt = topk._dealt(df, 100)
    assert dealt.groupBy("shard").count().count() >= 3
    first = dealt.select("dim", F.col("shard").alias("home"), F.col("id").alias("query_id"), F.col("v").alias("qv"), F.array(F.lit(100).cast("long")).alias("scores"), F.array(F.lit(9).cast("long")).alias("times"))
    met = topk._meeting(first, topk._boxes(dealt), 5).groupBy("home", "shard").count().collect()
    side = {r["shard"]: r["side"] for r in dealt.groupBy("shard").agg(F.max(F.col("id") % 2).alias("side")).collect()}
    assert all(side[r["home"]] == side[r["shard"]] for r in met)


def test_op4_in_several_shards_equals_sql(spark, monkeypatch):
    """As the query runs it, with so small shards and blocks that scores are carried between many."""
    data = "/root/testdata/sf0.01"
    search = topk.top_k
    monkeypatch.setattr(topk, "top_k", lambda vectors, queries: search(vectors, queries, shard=60, block=7))
    assert_same(topk.exact_top_k(spark, data), topk.ORACLES["op4_exact_top_k"], data)


def test_license_scan_finds_edited_notices(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    notice = licenses.TEMPLATES["MIT notice"]
    words = notice.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 17 != 3).replace("Software", "SOFTWARE")
    texts = [
        filler(30) + "\n" + notice + "\n" + filler(40), filler(5) + " " + edited, filler(200), " ".join(words[:20]), None, "", notice + " " + filler(50) + " " + notice,
        "Released under the MIT License.", "Released to the public", filler(20000) + " licensed under CC BY-NC 4.0. " + filler(3),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    found = {}
    for r in licenses.scan(df).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sorted(found) == [0, 1, 6, 7, 9]
    assert {r["license"] for r in found[0] + found[1] + found[6]} == {"MIT notice"}
    assert len(found[6]) == 2 and found[7][0]["license"] == "MIT line" and found[9][0]["license"] == "CC-BY-NC-4.0 line"
    r = found[0][0]
    assert texts[0][r["start"] : r["end"]] == notice.rstrip(".") and r["matched_words"] == r["template_words"]
    assert texts[9][found[9][0]["start"] : found[9][0]["end"]] == "licensed under CC BY-NC 4.0"
    assert licenses.scan(df.limit(0)).count() == 0


def test_op6_finds_every_line_of_the_table(spark):
    data = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["license"]) for r in licenses.license_scan(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    lines = {n: t for n, t in licenses.TEMPLATES.items() if n.endswith("line")}
    expected = {(d["doc_id"], n) for d in docs for n, t in lines.items() if t in d["text"]}
    assert expected and found >= expected


def test_winnowing_keeps_a_fingerprint_of_every_window():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 50, 200).astype(np.uint64)
    places = licenses.winnow(hashes)
    assert all(any(a <= p < a + licenses.WINDOW for p in places) for a in range(200 - licenses.WINDOW + 1))

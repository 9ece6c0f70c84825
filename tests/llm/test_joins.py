"""Joins and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import clusters, line_dedup, ngram_join
from tests.oracle import assert_same

DATA = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, n, letters="abc"):
    s = list(s)
    for _ in range(n):
        i, k = rng.randint(0, max(0, len(s) - 1)), rng.random()
        if k < 0.33:
            s.insert(i, rng.choice(letters))
        elif s and k < 0.66:
            s.pop(i)
        elif s:
            s[i] = rng.choice(letters)
    return "".join(s)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(90)] + [(7, 7)]
    groups = clusters.Sets(list(range(6000)))
    for a, b in edges:
        groups.union(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    found = [(r["node"], r["component"]) for r in clusters.components(df).collect()]
    assert sorted(found) == sorted((x, groups.find(x)) for x in nodes)
    assert clusters.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [-1, 150, 1 << 16])
def test_few_edges_take_no_rounds(spark, monkeypatch, few):
    rng = random.Random(2)
    edges = [(rng.randint(-400, 400), rng.randint(-400, 400)) for _ in range(250)] + [(2000 + i, 2001 + i) for i in range(50)] + [(-(1 << 63), (1 << 63) - 1)]
    spread = {x: k for k, x in enumerate(sorted({x for e in edges for x in e}))}
    groups, names = clusters.Sets(list(range(len(spread)))), list(spread)
    for a, b in edges:
        groups.union(spread[a], spread[b])
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    written = []
    cut = clusters.cut
    monkeypatch.setattr(clusters, "FEW_EDGES", few)
    monkeypatch.setattr(clusters, "cut", lambda df, label: written.append(label) or cut(df, label))
    found = [(r["node"], r["component"]) for r in clusters.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()]
    assert sorted(found) == sorted((x, names[groups.find(spread[x])]) for x in nodes)
    assert written == ["edges"] if few > len(edges) else len(written) >= 5


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_keys(edits):
    rng = random.Random(edits)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 16)))
        b = changed(rng, a, rng.randint(0, 5))
        near = distance(a, b) <= edits
        assert line_dedup.within(a, b, edits) is near, (a, b)
        if near and min(len(a), len(b)) > edits:
            short, long = sorted((a, b), key=len)
            assert set(line_dedup.line_keys(short, edits, 1)[0]) & {k for part in line_dedup.line_keys(long, edits, 1) for k in part}


def test_keys_meet_where_edits_grow_with_length():
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 30)))
        b = changed(rng, a, rng.randint(0, 3))
        short, long = sorted((a, b), key=len)
        if distance(a, b) <= (most := line_dedup.allowed(len(short), 3, 6)) and most:
            assert set(line_dedup.line_keys(short, 3, 6)[0]) & {k for part in line_dedup.line_keys(long, 3, 6) for k in part}


def brute_jaccard(texts):
    sets = {i: set(ngram_join.shingles(ngram_join.words_of(t)).tolist()) for i, t in texts.items()}
    ids = sorted(texts)
    groups = clusters.Sets(list(range(len(ids))))
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                groups.union(x, y)
    return {(i, len(sets[i]), ids[groups.find(x)]) for x, i in enumerate(ids)}


def near_texts(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 12, 60, 200]))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + [None, "", " \n", "One", "one", "A b c d e", "a B c d e f"] + ["same words again and again and again"] * 5


@pytest.mark.parametrize("block", [48 << 20, 3000])
def test_op10_by_brute_force(spark, monkeypatch, block):
    """With small blocks, components meet by leaders and by pairs of blocks."""
    monkeypatch.setattr(clusters, "BLOCK_BYTES", block)
    texts = dict(enumerate(near_texts(random.Random(8))))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, item string").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert found == brute_jaccard(texts)


def test_op10_equals_sql(spark):
    assert_same(ngram_join.ngram_join(spark, DATA), ngram_join.ORACLES["op10_ngram_join"])


def test_op10_on_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.jaccard_components(df).collect()) == [(0, 1), (1, 1), (2, 2), (3, 1), (3, 1)]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_prefix_guarantee():
    """Linking sets share as many prefix tokens as are due, for all pairs of sizes near each other."""
    for x in range(1, 300):
        for y in range(x, min(300, 4 * x // 3 + 1)):
            assert ngram_join.due(y) - ngram_join.due(x) <= ngram_join.least_common(y) - ngram_join.least_common(x)
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        common = rng.choice(10**6, n, replace=False)
        a, b = (np.unique(np.concatenate([common, rng.integers(10**6, 10**7, rng.integers(0, n // 4 + 1))])) for _ in range(2))
        if 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)):
            shared = np.intersect1d(a[: ngram_join.prefix_length(len(a))], b[: ngram_join.prefix_length(len(b))])
            assert len(shared) >= max(ngram_join.due(len(a)), ngram_join.due(len(b)))


def brute_lines(rows, edits=line_dedup.EDITS, per=line_dedup.CHARS_PER_EDIT):
    """What stays of each (doc_id, text), in order, those without an id last; equal rows are one document."""
    lines = sorted({x for _, t in rows if t for x in t.split("\n") if x.strip(line_dedup.SPACES)})
    groups = clusters.Sets(list(range(len(lines))))
    for i, a in enumerate(lines):
        for j in range(i):
            n = min(len(a), len(lines[j]))
            most = min(edits, n // per, n - 1)
            if most and abs(len(a) - len(lines[j])) <= most and distance(a, lines[j]) <= most:
                groups.union(i, j)
    names = {x: groups.find(i) for i, x in enumerate(lines)}
    seen, out = set(), {}
    for k, t in dict.fromkeys(rows):
        kept = []
        for x in (t or "").split("\n"):
            if x not in names or names[x] not in seen:
                kept.append(x)
                seen |= {names[x]} if x in names else set()
        out[k, t] = None if t is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("block", [48 << 20, 4000])
def test_op9_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK_BYTES", block)
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcd ") for _ in range(rng.choice([3, 5, 11, 12, 20, 24, 33]))) for _ in range(14)]
    texts = {i: "\n".join(rng.choice(["", " ", changed(rng, rng.choice(bases), rng.choice([0, 0, 1, 2, 4]))]) for _ in range(rng.randint(1, 7))) for i in range(40)}
    texts |= {90: None, 91: "", 92: "\n\n", 93: texts[0], 94: "x" * 3000 + "\n" + "y" * 12, 95: "z" + "x" * 2999}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, lines string").repartition(3)
    for edits, per in ((2, 12), (2, 1), (1, 4)):
        rows = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(df, edits, per).collect()}
        expected = {i: t for (i, _), t in brute_lines(sorted(texts.items()), edits, per).items()}
        assert {i: r["text"] for i, r in rows.items()} == expected
        for i, r in rows.items():
            worded = lambda t: sum(bool(x.strip(line_dedup.SPACES)) for x in (t or "").split("\n"))
            assert r["n_lines"] == worded(texts[i]) and r["n_lines"] - r["n_dropped"] == worded(expected[i])
            assert r["emptied"] == (worded(texts[i]) > 0 and worded(expected[i]) == 0)
            assert r["row"]["lines"] == "x"


def test_op9_odd_rows(spark):
    """Rows that repeat id and text are one document; other texts of an id are their own; those without an id come last."""
    line = "a line that is long enough to be compared with others"
    rows = [(None, line + "\nits own line"), (2, line), (2, line), (1, line + "!"), (3, line[1:] + "\nown line of this document which stays here"), (4, line), (4, "unique tail which exists nowhere else"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["row"]["doc_id"] or 0, r["text"] or "") for r in line_dedup.dedup_lines(df).collect())
    assert out == [(0, ""), (0, "its own line"), (1, line + "!"), (2, ""), (2, ""), (3, "own line of this document which stays here"), (4, ""), (4, "unique tail which exists nowhere else")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_link_by_as_many_edits_as_they_may_have(spark):
    rows = [(1, "Short line of text here, 28"), (2, "Short line of text here, 27"), (3, "twelve chars"), (4, "twelve char"), (5, "twelve-chars"), (6, "eleven char"), (7, "eleven-char")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["row"]["doc_id"] for r in line_dedup.dedup_lines(df).where("NOT emptied").collect()} == {1, 3, 4, 6, 7}


def test_op9_over_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").orderBy("doc_id").collect()]
    kept = {(r["row"]["doc_id"], r["row"]["text"]): r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == brute_lines(docs)


@pytest.mark.parametrize("how", ["hot", "no broadcast"])
def test_joins_with_hot_keys_and_without_broadcasts(spark, monkeypatch, how):
    """The ways that large and skewed tables take give the same rows."""
    if how == "hot":
        monkeypatch.setattr(clusters, "HOT_ROWS", 2)
        monkeypatch.setattr(clusters, "DRAWN", 1)
        monkeypatch.setattr(clusters, "MOST_HOT", 7)
    else:
        for module in (clusters, line_dedup, ngram_join):
            monkeypatch.setattr(module, "broadcast_if_small", lambda df, rows, size: df)
        monkeypatch.setattr(clusters, "WHOLE_BYTES", 1000)
        monkeypatch.setattr(clusters, "PART_BYTES", 500)
    rng = random.Random(3)
    texts = dict(enumerate(near_texts(rng)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert found == brute_jaccard(texts)
    lines = {i: "\n".join(changed(rng, "one line of some words which many hold", rng.randint(0, 9), "xyz") for _ in range(3)) for i in range(25)}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, text string").repartition(3)
    assert {r["row"]["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == {i: t for (i, _), t in brute_lines(sorted(lines.items())).items()}


def test_rows_of_hot_keys_go_one_way(spark, monkeypatch):
    """Hot keys take no joins of their own, and every item of a key gets into its star."""
    monkeypatch.setattr(clusters, "SPREAD", 5)
    monkeypatch.setattr(clusters, "HOT_ROWS", 64)
    monkeypatch.setattr(clusters, "DRAWN", 1)
    plans = {}
    cut = clusters.cut

    def told(df, label):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, label)

    for module in (clusters, ngram_join):
        monkeypatch.setattr(module, "cut", told)
    common = [f"w{i}" for i in range(40)]
    texts = {i: " ".join([*common, f"x{i}"]) for i in range(100)} | {100 + i: " ".join(f"y{i}_{j}" for j in range(9)) for i in range(20)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect()}
    assert found == brute_jaccard(texts)
    assert plans["needed"].count("Generate ") == 1 and plans["needed"].count("Join ") == 1
    assert plans["stars"].count("Join ") == 1
    rows = [(k, i) for k in range(3) for i in range(1000 * k, 1000 * k + 100)] + [(9, 5), (9, 1005), (10, 7)]
    keyed = spark.createDataFrame(rows, "key long, item long")
    edges = clusters.weak_edges(keyed, clusters.hot_keys(keyed, "key"))
    assert {(r["node"], r["component"]) for r in clusters.components(edges).collect()} == {(i, 0 if k < 2 else 2000) for k, i in rows if k < 3}
    assert edges.count() < 3 * 110


def test_keep_one_of_each_group(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, 1), (None, long, 2), (7, long + " x", 3), (5, "other words of five", 4), (5, long, 5), (9, None, 6), (9, None, 7), (None, "", 8), (5, "other words of five", 9), (None, "alone", 10), (None, "alone", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    out = ngram_join.keep_one(df)
    assert out.columns == df.columns
    found = sorted((r["k"] for r in out.collect()))
    assert [k for k in found if k not in (4, 9, 10, 11)] == [5, 6, 7, 8]
    assert len({4, 9} & set(found)) == 1 and len({10, 11} & set(found)) == 1
    assert ngram_join.keep_one(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "packing":
            assert docs.columns == columns
            docs = corpus_pipeline.cut(docs, "test")
            sizes.append(docs.count())
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    ids = docs.select("doc_id").distinct()
    assert ids.count() == sizes[-1]
    found = ngram_join.jaccard_components(before)
    assert found.where("doc_id <> component_id").count() == 0
    again = corpus_pipeline.run(spark, DATA)
    assert again.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


def test_pipeline_without_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names

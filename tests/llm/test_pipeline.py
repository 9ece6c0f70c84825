"""The pipeline's rows against a plain version of every stage, over documents with planted copies."""

import random
import zlib

import corpus_pipeline
import public_tokenizers as public
from pyspark.sql import functions as F

from factloom.llm import classifier, clusters, ngram_join, rules
from tests.llm.test_joins import brute_lines, changed
from tests.llm.test_native import counts


def documents():
    """Good and shouting texts of three hosts, with copies, near copies, shared lines, repeated rows and null ids."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    good = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "###", "CLICK", "|||"]) + str(rng.randint(0, 999)) for _ in range(12 * n))
    rows, shared = [], good(1)
    for i in range(60):
        text = junk(rng.randint(5, 9)) if i % 4 == 0 else good(rng.randint(3, 9))
        if i % 4 == 1:
            text += "\n" + changed(rng, shared, rng.randint(0, 2))
        rows.append((i, text, f"h{i % 3}"))
    whole = [t for i, t, _ in rows if i % 4 == 2]
    rows += [(100 + i, t, "h0") for i, t in enumerate(whole[:4])]  # copies
    rows += [(200 + i, t.replace("\n", " ", 3).replace(" ", " zz ", 1), "h1") for i, t in enumerate(whole[4:8])]  # near copies, whose lines differ
    rows += [(300 + i, "short text", "h2") for i in range(3)] + [(400, "one two three " * 40, "h2")]
    rows += [(500, good(6), "h0")] * 2 + [(None, good(6), "h1")] * 2 + [(600, None, "h1"), (601, "", None), (602, good(8), None)]
    return [(i, t, "en", h, len(t or "")) for i, t, h in rows]


def plain(rows, quality):
    """(doc_id, text) of what the four filtering stages leave."""
    text_of = {i: t for i, t, *_ in rows if i in quality}
    own = sorted(i for i in text_of if zlib.crc32(str(i).encode()) % 3 != 1)
    model = classifier.fit([classifier.features(text_of[i]) for i in own], [quality[i] for i in own])
    rows = [r for r in rows if model.score(classifier.features(r[1])) >= 0.5]

    def failed(text):
        n, _, _, _, repeated = counts(text)
        return n < rules.MIN_WORDS or 100 * repeated > rules.MAX_REPEATED * n

    rows = [r for r in rows if not failed(r[1])]  # the fixture's hosts fail alike, so none goes as a whole
    kept = brute_lines(sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0)))
    texts = [((i, t), kept[i, t]) for i, t, *_ in rows]
    texts = [(i, t) for (i, old), t in texts if (t or "").strip() or not (old or "").strip()]
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [set(ngram_join.shingles(ngram_join.words_of(t)).tolist()) for _, t in order]
    groups = clusters.Sets(list(range(len(order))))
    for x in range(len(order)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                groups.union(x, y)
    return [r for x, r in enumerate(order) if groups.find(x) == x]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = documents()
    quality = {i: int(i % 4 != 0) for i in range(60)}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), "test")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    expected = plain(rows, quality)
    assert found == sorted(expected, key=key)
    assert 20 < len(found) < 48 and {500, None, 602} <= {i for i, _ in found} and not {i for i, _ in found} & {400, 300, 600, 601, 0, 4}

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in expected}
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {(r["doc_id"], r["n"], r["all"]) for r in sums} == {(i, n, n) for i, n in tokens.items()}

"""Text functions against plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import extract

SENTENCES = [
    "I work at Acme.", "i work at acme.", "Mine uses explosives.", "ME uses Postgres.", "The company Acme uses i as a variable.", "I Like Jazz Music.", "Alice Smith lives in San Francisco, near Bob.",
    "nothing here", "Dana knows Sam and Kim Lee.", "She is an expert.", "Éva works for Çelik A.", "works at", "So it must be Berlin, because he lives in Berlin.", "They're based in New York-City & Co.",
    "and moved to Berlin", "Tim Cook is CEO", "Bob's dog likes Rex!!", "It is what it is.",
]


def expected(sentence):
    """Subject, relation and object by scanning matches in order."""
    relation = end = None
    for name, pattern, bounded in X.VERBS:
        m = re.search(rf"\b{pattern}" + (r"\b" if bounded else ""), sentence, re.I)
        if m:
            relation, end = name, m.end()
            break
    if relation is None:
        return None
    runs = list(re.finditer(r"\b[A-Z][\w.&-]*(?:\s+[A-Z][\w.&-]*)*", sentence))
    first = bool(re.search(r"\b(?:I|I'm|my|me|mine)\b", sentence, re.I))
    subject, subject_end = ("user", 0) if first else (runs[0].group(), runs[0].end()) if runs else (sentence.split()[0].strip(X.EDGE_PUNCTUATION) or "user", 0)
    after = [r.group().rstrip(X.EDGE_PUNCTUATION) for r in runs if r.start() >= max(end, subject_end)]
    tokens = [t.strip(X.EDGE_PUNCTUATION) for t in sentence.split() if t.strip(X.EDGE_PUNCTUATION)]
    return subject, relation, after[0] if after else tokens[-1], 0.9 if first and relation in X.EXPLICIT else 0.4


def test_candidates(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES)], "seq int, raw string")
    found = {r["sentence"]: (r["subject_name"], r["predicate"], r["object_literal"], r["confidence"]) for r in extract.candidates(df).collect()}
    for s in SENTENCES:
        for part in [p for p in re.split(r"(?<=[.!?])\s+", s.strip()) if p.strip()]:
            assert found.get(part) == expected(part), part


@pytest.mark.parametrize("a, b, same", [
    ("Acme", "ACME", True), ("Café", "CAFÉ", True), ("ЖУК", "жук", True), ("Weiß", "WEISS", True), ("Acme  Corp", "Acme Corp", True), (unicodedata.normalize("NFD", "Café"), "Café", True),
    ("Acme", "Acme.", False), ("Yahoo!", "Yahoo", False), ("Café", "Cafe", False),
])
def test_entity_key(spark, a, b, same):
    x, y = spark.createDataFrame([(a,), (b,)], "s string").select(X.entity_key("s")).collect()
    assert (x == y) is same


def test_entities_keep_the_oldest_spelling(spark):
    df = spark.createDataFrame([("a", "ACME", 2), ("a", "Acme", 1), ("b", "acme", 3)], "namespace string, subject_name string, seq int")
    assert {(r["namespace"], r["name"]) for r in extract.resolve_entities(df).collect()} == {("a", "Acme"), ("b", "acme")}


def test_router(spark):
    df = spark.createDataFrame([(0, "So she works at Acme."), (1, "I work at Acme."), (2, "He likes Bob."), (3, "works at Acme")], "seq int, raw string")
    found = {r["seq"]: r["reasons"] for r in extract.route(extract.candidates(df)).collect()}
    assert found[0] == ["derives"] and found[1] == [] and found[3] == []
    assert found[2] == ["coreference"]


@pytest.mark.parametrize("text, user, inference, score", [
    ("", True, False, 0.0), ("ok thanks", True, False, 1.5), ("We met Bob on 2024-01-02 for lunch", True, False, 4 + 1.6 + 0.9 + 1.2 + 0.18 * 4), ("he moved to Berlin", False, True, 4 + 1.2 + 0.18 - 2 - 1),
])
def test_salience(spark, text, user, inference, score):
    row = spark.createDataFrame([(text, user, inference)], "t string, u boolean, i boolean").select(X.salience(F.col("t"), F.col("u"), F.col("i")).alias("s")).first()
    assert row["s"] == pytest.approx(score)


def test_query_words_that_are_operators_are_terms():
    assert X.query_terms('AND "or" NOT* near(café)') == ["and", "or", "not", "near", "cafe"]
    assert X.query_terms("?! ...") == []

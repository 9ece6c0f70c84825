"""Edited license lines and notices against alignment at every place of the text, without an index."""

import random

from factloom.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)
LINES = [n for n in licenses.TEMPLATES if n.endswith("line")]


def best_match(text, name):
    """Most words of a template that align at any start, where they reach the coverage."""
    own = INDEX.words[INDEX.names.index(name)].tolist()
    words = licenses.word_hashes(licenses.WORD.findall(text)).tolist()
    m = max(licenses.align(own, words, s, licenses.band_of(len(own)))[0] for s in range(-len(own), len(words) + 1))
    return m if m >= licenses.MIN_COVERAGE * len(own) else None


def best_matches(text):
    return {n: m for n in INDEX.names if (m := best_match(text, n))}


def found_matches(text):
    out = {}
    for name, m, *_ in licenses.matches(text, INDEX):
        out[name] = max(m, out.get(name, 0))
    return out


def edits(words):
    for i in range(len(words)):
        yield words[:i] + words[i + 1 :]
        yield words[:i] + ["zzz"] + words[i + 1 :]
        yield words[:i] + ["zzz"] + words[i:]


def test_lines_with_one_word_less():
    assert found_matches("Released under MIT License.") == found_matches("Released under an MIT License") == {"MIT line": 4}
    assert found_matches("Released x under a MIT y License") == {"MIT line": 4}


def test_every_one_and_two_word_edit_of_the_lines():
    reported = 0
    for name in ("MIT line", "CC-BY-NC-4.0 line"):
        words = licenses.WORD.findall(licenses.TEMPLATES[name])
        seen = {" ".join(["pre", *v, "post"]) for e in edits(words) for v in [e, *edits(e)]}
        for text in sorted(seen):
            expected = best_match(text, name)
            assert found_matches(text).get(name) == expected, text
            reported += expected is not None
    assert reported > 100


def test_notices_edited_at_every_fingerprint():
    rng = random.Random(8)
    for name, text in licenses.TEMPLATES.items():
        words = licenses.WORD.findall(text)
        for gap in (5, 6, 7):
            edited = ["zzz" if i % gap == gap // 2 else w for i, w in enumerate(words)]
            edited = ["the", "of", "to"] * rng.randint(0, 3) + edited
            assert found_matches(" ".join(edited)) == best_matches(" ".join(edited)), (name, gap)


def test_copies_side_by_side():
    for name in LINES:
        words = licenses.WORD.findall(licenses.TEMPLATES[name])
        found = [m for m in licenses.matches(" ".join(words * 3), INDEX) if m[0] == name]
        assert [m[1] for m in found] == [len(words)] * 3


def test_lines_in_whole_documents(spark):
    """Every match of the table's texts is that of plain alignment at every place, and there is no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 7 = 0 OR text LIKE '%icense%'").collect()
    reported = 0
    for r in docs:
        if 0 < len(licenses.WORD.findall(r["text"])) < 400:
            expected = {n: m for n in LINES if (m := best_match(r["text"], n))}
            assert {n: m for n, m in found_matches(r["text"]).items() if n in LINES} == expected, r["doc_id"]
            reported += len(expected)
    assert reported > 20

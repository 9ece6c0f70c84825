"""Encoding, files and packing against the public tokenizers themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from factloom.llm import bpe, packing, token_files
from factloom.llm.tokens import byte_level, word_level

DATA = "/root/testdata/sf0.001"
PARTS = [" ", "\n", "\t", "a", "B", "é", "É", "ß", ".", ",", "'s", "'ll", "!", "1", "23", "  ", " ", "中文", "😀", "\x1c", "é", "Σ", "İ", "\r\n", "<|endoftext|>", "ſ", "\x00", "word", " the"]


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return [*made, None, "", " ", "  ", "\n", "a\n", "a \n b", "x" * 5000, "the " * 3000, "é" * 999 + " end"]


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def tiktoken_ids():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda x: encoding.encode_ordinary(x or "")


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, repeated rows, extra columns with clashing names."""
    rows = [(i % 400 if i != 5 else None, t, "x", i) for i, t in enumerate(texts())] + [(1, "again", "x", 0)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, t long")


def test_ids_equal_the_libraries(documents):
    sample = texts() + [r["text"] for r in documents.collect()]
    expected = tiktoken_ids()
    codec = bpe.codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    for t, ids in zip(sample, codec.encode(sample), strict=True):
        assert ids == packed(expected(t)), t
        assert codec.decode(ids) == (t or "").encode()
    for name, own in (("byte_bpe_50k.json", byte_level(public.path("byte_bpe_50k.json"), public.PATTERN)), ("word_bpe_49k.json", word_level(public.path("word_bpe_49k.json")))):
        expected = library(name)
        for t, ids in zip(sample, own.texts(sample), strict=True):
            assert ids == packed(expected(t)), t


def test_small_vocabulary_by_hand(tmp_path):
    """Ranks of single bytes, then "ab" and "abc" without "bc": merges follow the ranks; gaps are refused."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cab"]
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    codec = bpe.Codec(str(path), r"\S+|\s+")
    assert np.frombuffer(codec.encode(["abcab cab"])[0], "<u4").tolist() == [257, 256, 32, 258]
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def test_op1(spark, documents):
    expected = tiktoken_ids()
    for r in bpe.byte_bpe(spark, DATA).join(documents, "doc_id").collect():
        ids = expected(r["text"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_encode_keeps_rows_and_columns(odd):
    path = public.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(odd, path, public.PATTERN, into="own_ids"), path, public.PATTERN, ids="own_ids")
    assert out.columns == [*odd.columns, "own_ids", "decoded"]
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in out.collect())
    assert bpe.encode(odd.limit(0), path, public.PATTERN).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 10**12), (700, 5), (3000, 10**9), (1000, 0)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = token_files.EliasFano.build(values)
        assert code.all().tolist() == values.tolist() == [code.select(i) for i in range(n)]
        with pytest.raises(IndexError):
            code.select(n)
    code = token_files.EliasFano.build(np.arange(0, 10**7, 1000))
    assert len(code.low) + len(code.high) < 10_000 * 13 // 8 + 100


def test_shard_round_trip():
    documents = [b"", packed([1, 2, 70_000]), packed([5])]
    shard = token_files.load(token_files.dump([None, 3, 9], documents))
    assert [shard.document(i).tolist() for i in range(3)] == [[], [1, 2, 70_000], [5]]
    assert shard.doc_ids.tolist()[1:] == [3, 9]
    with pytest.raises(ValueError):
        token_files.load(b"x" * 100)


def test_op8(spark, documents):
    expected, start = library("word_bpe_49k.json"), 0
    found = {r["doc_id"]: r for r in token_files.token_files(spark, DATA).collect()}
    for r in documents.orderBy("doc_id").collect():
        ids = [*expected(r["text"]), 1]
        row = found.pop(r["doc_id"])
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert not found


def test_token_files_with_odd_rows(spark, odd, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/files"
    monkeypatch.setattr(token_files, "GROUP", 2)
    manifest = token_files.write(odd, public.path("word_bpe_49k.json"), folder, docs_per_shard=50, bytes_per_shard=2000)
    rows = token_files.read(spark, folder).orderBy("start").collect()
    assert len(rows) == odd.count() and manifest.count() > 5
    ids = [r["doc_id"] for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    empty = token_files.write(odd.limit(0), public.path("word_bpe_49k.json"), f"file://{tmp_path}/none")
    assert empty.count() == 0 and token_files.read(spark, f"file://{tmp_path}/none").count() == 0


def check_packing(pieces, lengths, length=1024):
    covered, used = {}, {}
    for d, start, n, q, offset in pieces:
        assert n > 0
        covered.setdefault(d, []).append((start, n))
        used.setdefault(q, []).append((offset, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(covered.pop(d)):
            assert start == at
            at += k
        assert at == n
    for spans in used.values():
        at = 0
        for offset, k in sorted(spans):
            assert offset == at
            at += k
        assert at <= length
    assert not covered and len(used) == -(-sum(lengths) // length)
    return used


def test_packing_of_any_lengths():
    rng = random.Random(2)
    for trial in range(60):
        lengths = [rng.choice([1, 2, rng.randint(1, 50), rng.randint(1, 1500), 1024, 1025, rng.randint(1, 9000)]) for _ in range(rng.randint(1, 120))]
        check_packing(packing.pack_lengths(lengths), lengths)


def test_packing_balances_cost():
    lengths = [900] * 20 + [100] * 124 + [50] * 40
    pieces = packing.pack_lengths(lengths)
    check_packing(pieces, lengths)
    cost = {}
    for _, _, n, q, _ in pieces:
        cost[q] = cost.get(q, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    assert max(cost.values()) < 2 * sum(cost.values()) / len(cost)


def test_op5(spark, documents):
    expected = library("byte_bpe_50k.json")
    ids = {r["doc_id"]: [*expected(r["text"]), 0] for r in documents.collect()}
    rows = packing.packing(spark, DATA).collect()
    places = {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(packed(own[r["start"] : r["start"] + r["length"]]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d in ids:
        assert sum(r["length"] for r in rows if r["doc_id"] == d) == len(ids[d])
    assert all(sum(n for _, n in p) <= 1024 and sorted(p)[0][0] == 0 for p in places.values())
    assert 1024 * len(places) - sum(map(len, ids.values())) < 1024 * documents.rdd.getNumPartitions()


def test_packing_of_odd_rows(odd):
    path = public.path("byte_bpe_50k.json")
    rows = packing.pack(odd, path, public.PATTERN)
    assert rows.agg(F.sum("length")).first()[0] == sum(len(x) + 1 for x in map(tiktoken_ids(), [r["text"] for r in odd.collect()]))
    assert packing.pack(odd.limit(0), path, public.PATTERN).count() == 0


def test_plain_words_are_those_of_one_pattern(tmp_path):
    assert bpe.KNOWN == public.PATTERN
    tokens = [bytes([b]) for b in range(256)] + [b"b.", b" a", b"b\n"]
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    found = bpe.Codec(str(path), r"\S+|\s+").encode(["ab. ab\nab"])[0]
    assert np.frombuffer(found, "<u4").tolist() == [97, 256, 32, 97, 98, 10, 97, 98]


def test_plain_words_take_no_pattern(monkeypatch):
    own = bpe.Codec(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(11)
    parts = [*PARTS, "ª", "µ", "ɏ", "ɐ", "ñ", "\n", "\n", "$$$", ".", ")", "Wort", "ǅ", "²", "_", "'", "-"]
    for _ in range(20000):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        found = bpe.plain(word)
        assert found is None or found == own.findall(word), word
    asked = []
    findall = own.findall
    monkeypatch.setattr(own, "findall", lambda word: asked.append(word) or findall(word))
    text = "Ein Wort, übel.\nZwei lines$$$\nthree words"
    expected = packed(tiktoken_ids()(text))
    assert own.encode([text]) == [expected] and not asked
    assert own.encode([text + " it's 5\n\n"]) == [packed(tiktoken_ids()(text + " it's 5\n\n"))] and asked


def test_lines_take_no_library(monkeypatch):
    from factloom.llm.tokens import WordLevel

    own, expected = WordLevel(public.path("word_bpe_49k.json")), library("word_bpe_49k.json")
    odd = ["a\n", "\n\n", "a\ńb", "Σ\nΣ", "5\n'S x", "\r\na", "x\n"]
    assert own.texts(odd) == [packed(expected(t)) for t in odd]
    monkeypatch.setattr(own, "library", None)
    texts = ["Ein Wort, übel.\nZwei lines$$$\nthree words"] * 2 + ["one.\nTwo"]
    assert own.texts(texts) == [packed(expected(t)) for t in texts]

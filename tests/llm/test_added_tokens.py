"""Texts that hold the tokenizer files' added tokens, against an untouched Tokenizer."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as public
import pytest

from factloom.llm import packing, token_files
from factloom.llm.tokens import byte_level, word_level

TEXTS = [
    "a <|endoftext|> b", None, "", "plain Text's end", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", "É <|startoftext|>\n\n b <|endoftext|>", "A <|EndOfText|> |>",
    "<|endoftext", "the  <|endoftext|>  \t the" * 50,
]


def ids_of(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path(name))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def check_pieces(rows):
    expected = [[*ids, 0] for ids in ids_of("byte_bpe_50k.json")]
    assert {r["doc_id"] for r in rows} == set(range(len(TEXTS)))
    for r in rows:
        own = expected[r["doc_id"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(packed(own[r["start"] : r["start"] + r["length"]])))


def test_ids_of_added_tokens():
    assert ids_of("byte_bpe_50k.json")[0] == [64, 220, 50256, 275] and ids_of("word_bpe_49k.json")[0] == [320, 49407, 321]
    for name, own in (("byte_bpe_50k.json", byte_level(public.path("byte_bpe_50k.json"), public.PATTERN)), ("word_bpe_49k.json", word_level(public.path("word_bpe_49k.json")))):
        assert own.with_added(TEXTS) == [packed(ids) for ids in ids_of(name)]


def test_op5_and_the_pipelines_packing(spark, folder):
    check_pieces(packing.packing(spark, folder).collect())
    check_pieces(corpus_pipeline.pack(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect())


def test_op8(spark, folder):
    start = 0
    rows = token_files.token_files(spark, folder).orderBy("doc_id").collect()
    for r, ids in zip(rows, ids_of("word_bpe_49k.json"), strict=True):
        ids = [*ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)

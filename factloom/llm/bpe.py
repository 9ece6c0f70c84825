"""Operator 1: byte-level BPE encoding and decoding.

The vocabulary's ranks become a sentencepiece BPE model, serialised here field by field: each byte is mapped to one
letter, a piece's score is its negative rank, and normalisation is the identity. Pre-tokens are encoded by that model
and decoded by the inverse mapping.

Defined results: a null text counts as empty (no ids, empty bytes); rows, repeated ones too, and extra columns stay as
they are, but a column that has the result's name is replaced; texts of any length are encoded whole; an empty table
gives no row.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import MARKS, WordCache, prepare, table

#: A byte b stands as the letter of code point FIRST_LETTER + b, which sentencepiece treats like any other.
FIRST_LETTER = 0x100
#: The pattern that `plain` knows; under any other all words take the pattern itself.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protocol-buffer field: bytes by length, floats as 32 bits, integers as varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def letters(token: bytes) -> str:
    return "".join(chr(FIRST_LETTER + b) for b in token)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto of type BPE; a piece's id is its rank, the unknown piece comes last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [
        _field(1, _field(1, letters(token).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


def plain(word: str) -> list[str] | None:
    """The pre-tokens, under KNOWN, of Latin letters and marks, after one space or none, on one line or several; None for
    all other words, which take the pattern itself."""
    out = []
    for i, line in enumerate(word.split("\n") if "\n" in word else (word,)):
        core = line.rstrip(MARKS)
        letters = core[1:] if not i and core[:1] == " " else core
        if not letters.isalpha() or not letters.isascii() and max(letters) >= "ɐ":
            return None
        if i:
            out.append("\n")
        out.append(core)
        if len(core) < len(line):
            out.append(line[len(core) :])
    return out


class Codec:
    """Encodes and decodes by one vocabulary; workers keep one for each file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.findall = regex.compile(pattern).findall
        self.known = pattern == KNOWN
        whole = self.model.encode([letters(t) for t in self.tokens], num_threads=1)
        #: Tokens that merging by rank doesn't reach: a pre-token that equals one takes its id at once.
        self.unreached = {t: r for r, (t, ids) in enumerate(zip(self.tokens, whole, strict=True)) if ids != [r]}
        self.pretokens: dict[str, bytes] = {}
        self.cache = WordCache(self._words, leading=True)

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.pretokens) > 400_000:
            self.pretokens.clear()
        kept = self.pretokens
        lists = [self.known and plain(w) or self.findall(w) for w in words]
        missing = list(set().union(*lists).difference(kept))
        kept.update(zip(missing, self._pretokens(missing), strict=True))
        get = kept.__getitem__
        out = [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in lists]
        for m in missing:
            if len(m) > 48:
                kept.pop(m, None)
        return out

    def _pretokens(self, texts: list[str]) -> list[bytes]:
        """The ids of pre-tokens; all bytes become letters at once."""
        ends = [0, *accumulate(len(t) if t.isascii() else len(t.encode()) for t in texts)]
        raw = "".join(texts).encode()
        mapped = (np.frombuffer(raw, np.uint8).astype("<u2") + FIRST_LETTER).tobytes().decode("utf-16-le")
        found = self.model.encode([mapped[a:b] for a, b in zip(ends, ends[1:])], num_threads=1)
        if self.unreached:
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                if raw[a:b] in self.unreached:
                    found[i] = [self.unreached[raw[a:b]]]
        ids = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        bounds = [0, *accumulate(4 * len(x) for x in found)]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.cache.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add a column of ids, as little-endian unsigned 32-bit integers, of each whole text."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(codec(path, pattern).encode(texts.to_pylist()), pa.binary())

    return docs.withColumn(into, ids(docs[text]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add a column of the bytes that the ids stand for; null ids give null."""

    @F.arrow_udf("binary")
    def text(blobs: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if b is None else own.decode(b) for b in blobs.to_pylist()], pa.binary())

    return encoded.withColumn(into, text(encoded[ids]))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded; digests of both."""
    import public_tokenizers as public

    prepare(spark)
    path, pattern = public.path("byte_bpe_50k.tiktoken"), public.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, path, pattern), path, pattern)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_byte_bpe": byte_bpe}
ORACLES: dict[str, str] = {}

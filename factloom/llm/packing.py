"""Operator 5: packing documents into sequences of bounded length, balanced by cost.

A sequence costs LINEAR a token and QUADRATIC a squared piece length, as attention inside a piece does. Documents are
cut into pieces of at most the sequence length. In descending length each piece goes to the sequence of lowest cost
that still has room for it; a piece that no open sequence can hold is cut over the roomiest ones. There are as many
sequences as the tokens need, so at most one of a group isn't full.

A group is a run of documents of one input partition, of bounded size; nothing is shuffled, so no key can be hot, and
a task that runs again over the same split gives the same groups. Sequence ids hold the partition in their high bits.

Defined results: a null text counts as empty and has the end id alone; repeated rows are packed as often as they come;
an empty table gives no row; extra columns aren't carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import prepare, release, table
from factloom.llm.tokens import byte_level

LENGTH = 1024
#: Cost of a token, and of a squared token of a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A group is closed at this many tokens.
GROUP_TOKENS = 1 << 20
#: Groups of a partition have ids below this; a group's sequences below SEQUENCES.
GROUPS, SEQUENCES = 1 << 20, 1 << 20


class Cheapest:
    """Sequences by room: a heap of (cost, sequence) for each amount of room, and a tree of minima over the amounts."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        self.tree = [NONE] * (2 * self.base)

    def _renew(self, room: int) -> None:
        i = self.base + room
        self.tree[i] = self.heaps[room][0] if self.heaps[room] else NONE
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._renew(room)

    def take(self, size: int, room_of: list[int]) -> int | None:
        """The cheapest sequence with room for `size`, taken out; None if there is none."""
        a, b, best = self.base + size, 2 * self.base, NONE
        while a < b:
            if a & 1:
                best, a = min(best, self.tree[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, self.tree[b])
            a, b = a // 2, b // 2
        if best is NONE:
            return None
        room = room_of[best[1]]
        heapq.heappop(self.heaps[room])
        self._renew(room)
        return best[1]


NONE = (float("inf"), -1)


def pack_lengths(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths, all above zero."""
    total = sum(lengths)
    count = -(-total // length)
    pieces = sorted(((min(length, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, length)), key=lambda p: (-p[0], p[1], p[2]))
    whole = [length] * (count - 1) + [total - (count - 1) * length]  # the last one's room is what the others leave, so these fill up
    room, cost = list(whole), [0.0] * count
    cheapest = Cheapest(length)
    for q in range(count):
        cheapest.put(room[q], 0.0, q)
    out: list[tuple[int, int, int, int, int]] = []

    def place(q: int, size: int, d: int, start: int) -> None:
        out.append((d, start, size, q, whole[q] - room[q]))
        room[q] -= size
        cost[q] += LINEAR * size + QUADRATIC * size * size

    misfits = []
    for size, d, start in pieces:
        q = cheapest.take(size, room)
        if q is None:
            misfits.append((size, d, start))
        else:
            place(q, size, d, start)
            if room[q]:
                cheapest.put(room[q], cost[q], q)
    roomy = sorted((-room[q], q) for q in range(count) if room[q])
    at = 0
    for size, d, start in misfits:
        while size:
            q = roomy[at][1]
            part = min(size, room[q])
            place(q, part, d, start)
            size, start = size - part, start + part
            at += not room[q]
    return out


def pack(
    docs: DataFrame, path: str, pattern: str, end_id: int = 0, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", added: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    With `added`, the file's added tokens in a text get their own ids, as the library gives them by default.
    """
    end = end_id.to_bytes(4, "little")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def packed(keys: list, documents: list[bytes], base: int) -> Iterator[pa.RecordBatch]:
        found = pack_lengths([len(d) // 4 for d in documents], length)
        for a in range(0, len(found), 512):
            rows = [
                (keys[d], s, n, documents[d][4 * s : 4 * (s + n)], len(documents[d]) // 4, base + q, o)
                for d, s, n, q, o in found[a : a + 512]
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * GROUPS * SEQUENCES
        keys: list = []
        documents: list[bytes] = []
        size = 0
        for batch in batches:
            keys += batch.column(0).to_pylist()
            codec = byte_level(path, pattern)
            fresh = [d + end for d in (codec.with_added if added else codec.texts)(batch.column(1).to_pylist())]
            documents += fresh
            size += sum(map(len, fresh)) // 4
            if size >= GROUP_TOKENS:
                yield from packed(keys, documents, base)
                keys, documents, size, base = [], [], 0, base + SEQUENCES
        if keys:
            yield from packed(keys, documents, base)
        del keys, documents
        release()

    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 1024 tokens."""
    import public_tokenizers as public

    prepare(spark)
    pieces = pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, added=True)
    return digest(pieces)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": packing}
ORACLES: dict[str, str] = {}

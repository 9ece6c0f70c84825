"""Operator 8: token ids in binary files with Elias-Fano coded document boundaries.

A shard file holds the concatenated ids of its documents, 16 or 32 bits each, and the documents' end offsets as an
Elias-Fano sequence: the low bits packed, the high bits in unary, and the place of each 256th set bit as a 32-bit
sample for select. All integers are little-endian.

    magic    8 bytes  b"EFTOKEN1"
    header   5 x u64  documents, ids, low bits per offset, bytes per id, bytes of the high part
    doc ids  n x i64
    low      packed low bits of each end offset
    high     unary high parts: bit (end >> low bits) + i is set for document i
    samples  u32      place of set bits 0, 256, 512, ...
    ids      u16 or u32

Documents are cut into partitions by ranges of doc_id, sorted inside, and a partition into shards of bounded size, so files in shard order are in ascending doc_id
order; null doc_ids come first. The manifest, a Parquet table beside them, has a row for each shard: its name, first id's
place in the whole array, documents and ids. Places are summed up by partition, then inside, never on the driver. Defined results: a null text has the end id alone; rows that repeat are written again;
extra columns are not written; an empty table gives no shard. A shard's file name is a function of the job, the partition and
its part, written aside and moved, so a task that runs again replaces the same file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import cut, fresh_folder, prepare, table
from factloom.llm.tokens import word_level

MAGIC = b"EFTOKEN1"
SAMPLE = 256
#: Partitions of a group whose places are summed up together, and bytes of ids that a task reads back.
GROUP, READ_BYTES = 1024, 16 << 20


class EliasFano:
    """A non-decreasing sequence in near-minimal space with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, np.frombuffer(high, np.uint8), samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, low.tobytes(), high.tobytes(), places[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return part >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Value i: from the nearest sample, set bits are counted until bit i is met."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte = (place + 1) // 8
            word = int(self.high[byte]) & 0xFF << (place + 1) % 8
            while (ones := (word & 0xFF).bit_count()) < left:
                left -= ones
                byte += 1
                word = int(self.high[byte])
            word &= 0xFF
            for _ in range(left - 1):
                word &= word - 1
            place = 8 * byte + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def sound(self) -> bool:
        """Whether each sample is where its set bit is."""
        places = self.samples.astype(np.int64)
        if len(places) != -(-self.n // SAMPLE) or len(places) and places[-1] >= 8 * len(self.high):
            return False
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        own = self.high[places // 8] & (2 << (places % 8)) - 1  # up to the sampled bit itself
        return bool(np.all(before[places // 8] + np.bitwise_count(own) == SAMPLE * np.arange(len(places)) + 1) and np.all(self.high[places // 8] >> (places % 8) & 1))

    def all(self) -> np.ndarray:
        """Every value, in one pass."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (places - np.arange(self.n)) << self.low_bits | low


@dataclass
class Shard:
    doc_ids: np.ndarray
    ends: EliasFano
    ids: np.ndarray

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def dump(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """A shard's bytes; documents as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    ends = EliasFano.build(np.cumsum([len(d) // 4 for d in documents], dtype=np.uint64))
    low_size = len(ends.low)
    keys = np.array([-(1 << 63) if x is None else x for x in doc_ids], "<i8")  # the least value stands for null
    header = struct.pack("<5Q", len(documents), len(ids), ends.low_bits, 4 if wide else 2, len(ends.high))
    assert low_size == (len(documents) * ends.low_bits + 7) // 8
    return b"".join(
        (MAGIC, header, keys.tobytes(), ends.low, ends.high.tobytes(), ends.samples.tobytes(), (ids if wide else ids.astype("<u2")).tobytes())
    )


def load(blob: bytes) -> Shard:
    if blob[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, total, low_bits, width, high_size = struct.unpack_from("<5Q", blob, 8)
    at = 48
    keys = np.frombuffer(blob, "<i8", n, at)
    at += 8 * n
    low = blob[at : (at := at + (n * low_bits + 7) // 8)]
    high = blob[at : (at := at + high_size)]
    samples = np.frombuffer(blob, "<u4", -(-n // SAMPLE), at)
    ids = np.frombuffer(blob, "<u4" if width == 4 else "<u2", total, at + 4 * len(samples))
    return Shard(keys, EliasFano(n, low_bits, low, high, samples), ids)


def _store(uri: str):
    """The file system and path of a shared folder: local, or any that pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, blob: bytes) -> None:
    store, path = _store(uri)
    store.create_dir(path, recursive=True)
    aside = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        out.write(blob)
    store.move(aside, f"{path}/{name}")


def _get(uri: str, name: str) -> bytes:
    store, path = _store(uri)
    with store.open_input_file(f"{path}/{name}") as source:
        return source.read()


def write(
    docs: DataFrame, path: str, folder: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    docs_per_shard: int = 4096, bytes_per_shard: int = 64 << 20,
) -> DataFrame:
    """Tokenise and write shards under `folder`, and their manifest, which is returned as read back."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    shards = max(1, -(-docs.select(doc_id).count() // docs_per_shard))
    end = struct.pack("<I", end_id)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, size = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        documents: list[bytes] = []

        def flush() -> pa.RecordBatch:
            name = f"shard-{shard:08d}-{part:06d}.eft"
            _put(folder, name, dump(keys, documents))
            row = ([shard], [part], [name], [len(keys)], [size // 4])
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if v == [name] else pa.int64()) for v in row], ["shard", "part", "name", "documents", "ids"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            fresh = [d + end for d in word_level(path).with_added(batch.column(1).to_pylist())]
            documents += fresh
            size += sum(map(len, fresh))
            if size > bytes_per_shard:
                yield flush()
                part, size, keys, documents = part + 1, 0, [], []
        if keys:
            yield flush()

    dealt = rows.repartitionByRange(shards, "k").sortWithinPartitions("k", "t")
    written = cut(dealt.mapInArrow(tokenise, "shard long, part long, name string, documents long, ids long"), "shards")
    # running sums in two steps: over groups of partitions, of which there are few, and inside each group
    group = F.floor(F.col("shard") / GROUP)
    before = W.orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = written.groupBy(group.alias("group")).agg(F.sum("ids").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("group").orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    placed = written.withColumn("group", group).join(groups, "group").withColumn("start", F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    placed.select("name", "start", "documents", "ids").write.parquet(f"{folder}/manifest")
    return manifest_of(spark, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name string, start long, documents long, ids long").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of the manifest's shards: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit).

    Each document's bounds come from the shard's coded ends by select.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, count in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = load(_get(folder, name))
                if shard.ends.n != count or not shard.ends.sound():
                    raise ValueError(f"{name}: not the shard of the manifest, or its select samples are wrong")
                first = 0
                for a in range(0, count, 256):
                    ends = [shard.ends.select(i) for i in range(a, min(a + 256, count))]
                    starts = [first, *ends[:-1]]
                    first = ends[-1]
                    part = [shard.ids[x:y].astype("<u4").tobytes() for x, y in zip(starts, ends, strict=True)]
                    keys = [None if k == -(1 << 63) else int(k) for k in shard.doc_ids[a : a + 256]]
                    columns = (keys, [start + x for x in starts], [y - x for x, y in zip(starts, ends, strict=True)])
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(part, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    manifest = manifest_of(spark, folder)
    total = manifest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids")).first()
    parts = max(1, min(total["n"], -(-4 * total["ids"] // READ_BYTES)))
    return manifest.select("name", "start", "documents").repartition(parts).mapInArrow(shards, "doc_id long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` written to token files and read back; each document's place and checksum."""
    import public_tokenizers as public

    prepare(spark)
    folder = fresh_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": token_files}
ORACLES: dict[str, str] = {}

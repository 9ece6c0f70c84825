"""Operator 10: n-gram Jaccard self-join by filtering under multiple global orders.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets of sizes x and y with Jaccard
similarity t have at least t * max(x, y) tokens in common, so under any global order of tokens their prefixes of
x - ceil(t x) + k(x) tokens share at least k tokens. Order 1 is by hash. Prefix tokens are the join's keys; documents
with fewer than k shared tokens drop out; of the others' shared tokens those k - 1 that come last in order 2, by
document frequency (hot tokens above all others) and hash, aren't needed, as some common token remains. So frequent
passages join nothing unless documents consist of them.

What remains is a star for each key (no pairs of all members), whose components are tested inside (see clusters): there
an inverted index over the prefixes of order 1 counts shared tokens against the k due; candidates must also share prefix
tokens under order 3 and order 4 (multiplied hashes) before two sets are intersected.

Copies are told by a 128-bit digest of their words: inside a task only the first emits keys, so a group of copies sends
one row a token from each task, and classes of copies are joined back at the end.

Defined results: null or wordless texts have no shingles and are their own component; shorter texts than a shingle have
their whole word sequence as one; repeated rows return as often as they come; null doc_ids can be linked, and a
component of these alone has a null name; extra columns are ignored. `keep_one` keeps all rows without shingles, and of
each component the row of the least doc_id (null comes last), ties by a hash of the text; of rows that repeat it, one;
extra columns, of any name, stay.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.clusters import Sets, components, draw, hot_keys, linked, place, shared_keys, weak_edges
from factloom.llm.common import broadcast_if_small, cut, prepare, release, table

WORDS = 5
#: Similarity from which on documents link, in hundredths.
PERCENT = 75
#: Odd factors that make orders 3 and 4 of a token's hash.
ORDERS = (np.int64(0x2545F4914F6CDD1D), np.int64(0x369DEA0F31A53F85))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """The distinct n-word shingles as 64-bit hashes, ascending; all words as one where there are fewer than n."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7) - (1 << 63)], np.int64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x7FB5D329728EA185)
        out ^= out >> np.uint64(27)
    return np.unique(out.view(np.int64))


def least_common(size: int, percent: int = PERCENT) -> int:
    """Tokens that a set of this size shares with any that links to it, at least."""
    return -(-percent * size // 100)


def _due(least):
    """k by least_common, for numbers and arrays: a third of it for small sets, slower beyond."""
    return 1 + np.minimum(least // 3, 32 + (least - 96) // 8)


def due(size: int, percent: int = PERCENT) -> int:
    """k: shared tokens due in prefixes. It never grows faster than least_common, on which the guarantee rests.

    The more are due, the longer prefixes are, and the larger the part of a text that common passages may make up
    before they become candidates' only tie.
    """
    return int(_due(least_common(size, percent)))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - least_common(size, percent) + due(size, percent) if size else 0


class _Seen:
    """Digests a task has seen; forgetting some only means a copy more."""

    def __init__(self, most: int = 250_000):
        self.most, self.held = most, set()

    def first(self, digest: bytes) -> bool:
        if digest in self.held:
            return False
        if len(self.held) >= self.most:
            self.held.clear()
        self.held.add(digest)
        return True


def _name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sketch(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, digest, item, size, prefix): th a hash of the text as it is, prefix only for the first of copies in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            digests, items, sizes, prefixes = [], [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                digest = hashlib.md5(b" ".join(words)).digest()
                found = shingles(words, n)
                digests.append(digest)
                items.append(_name(digest))
                sizes.append(len(found))
                prefixes.append(found[: prefix_length(len(found), percent)] if len(found) and seen.first(digest) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(items, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "th", "digest", "item", "size", "prefix"],
            )
        release(_hashes)

    t = docs[f"`{text}`"].cast("string")
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    return rows.mapInArrow(run, "doc_id long, th long, digest binary, item long, size long, prefix array<bigint>")


def jaccard_clusters(payloads: list[bytes], labels: list[int], percent: int = PERCENT) -> list[int]:
    """Exact clusters of sets, given as ascending 64-bit hashes; equal labels are linked already."""
    sets = [np.frombuffer(p, np.int64) for p in payloads]
    groups = Sets(labels)
    first: dict[bytes, int] = {}
    for i, p in enumerate(payloads):
        groups.union(i, first.setdefault(p, i))
    sizes = np.array([len(s) for s in sets], np.int64)
    least = -(-percent * sizes // 100)
    k = _due(least)
    prefixes = [s[:n] for s, n in zip(sets, (sizes - least + k).tolist(), strict=True)]
    others: dict[int, list[np.ndarray]] = {}

    def other_orders(i: int) -> list[np.ndarray]:
        if i not in others:
            n = int(sizes[i] - least[i] + k[i])
            with np.errstate(over="ignore"):
                others[i] = [np.sort(sets[i] * f)[:n] for f in ORDERS]
        return others[i]

    def link(i: int, j: int) -> bool:
        """The filters of orders 3 and 4, then the sets themselves."""
        for a, b in zip(other_orders(i), other_orders(j), strict=True):
            if not len(np.intersect1d(a, b, assume_unique=True)):
                return False
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)

    def candidates(i: int, hits: list) -> list[int]:
        """Items of the posting lists that share as many prefix tokens with i as are due, by count descending."""
        if not hits:
            return []
        items, counts = np.unique(np.concatenate(hits), return_counts=True)
        x, y = sizes[i], sizes[items]
        overlap = -(-percent * (x + y) // (100 + percent))
        need = np.minimum(np.minimum(k[i] + overlap - least[i], k[items] + overlap - least[items]), overlap)
        fit = (counts >= need) & (overlap <= np.minimum(x, y)) & (items != i)
        items, counts = items[fit], counts[fit]
        return items[np.argsort(-counts, kind="stable")].tolist()

    # first against leaders only, so that a group of near copies costs one test each
    order = sorted(first.values(), key=lambda i: (sizes[i], i))
    index: dict[int, list[int]] = defaultdict(list)
    for i in order:
        hits = [index[t] for t in prefixes[i].tolist() if t in index]
        for j in candidates(i, hits):
            if groups.find(i) != groups.find(j) and link(i, j):
                groups.union(i, j)
                break
        else:
            for t in prefixes[i].tolist():
                index[t].append(i)
    # then whatever still shares prefix tokens across clusters
    if len({groups.find(i) for i in order}) > 1:
        index.clear()
        tokens = np.concatenate([prefixes[i] for i in order])
        owners = np.repeat(np.array(order), [len(prefixes[i]) for i in order])
        roots = np.array([groups.find(i) for i in range(len(sets))])[owners]
        by = np.argsort(tokens, kind="stable")
        tokens, owners, roots = tokens[by], owners[by], roots[by]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
        ends = np.append(starts[1:], len(tokens))
        lists: dict[int, list[np.ndarray]] = defaultdict(list)
        for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            members = owners[a:b]
            for i in members.tolist():
                lists[i].append(members)
        for i in order:
            if i in lists:
                for j in candidates(i, lists[i]):
                    if groups.find(i) != groups.find(j) and link(i, j):
                        groups.union(i, j)
    return groups.labels()


def _leaders(docs: DataFrame, sketches: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(item, leader) of the texts that may link to others; leaders name components."""
    keyed = sketches.where("prefix IS NOT NULL").select("item", "size", F.explode("prefix").alias("key"))
    hot = hot_keys(draw(sketches.where("prefix IS NOT NULL"), "item").select(F.explode("prefix").alias("key")), "key")
    shared = shared_keys(keyed, hot)
    least = F.ceil(F.col("size") * percent / 100)
    k = F.lit(1) + F.least(F.floor(least / 3), 32 + F.floor((least - 96) / 8))  # _due
    last = F.row_number().over(W.partitionBy("item").orderBy(F.desc("df"), F.desc("key")))
    needed = cut(shared.withColumn("last", last).where(F.col("last") >= k).select("key", "item"), "needed")
    weak = cut(components(weak_edges(needed, hot)), "weak")

    # the sets of what remains are made again from the texts
    firsts = sketches.where("prefix IS NOT NULL").select("doc_id", "th", "item", "size").join(broadcast_if_small(weak, weak.count(), 32), F.col("item") == F.col("node"))
    chosen = firsts.groupBy("item", "component").agg(F.min(F.struct("doc_id", "th")).alias("k"), (70 * F.max("size") + 400).cast("long").alias("size"))  # set, orders and index
    chosen = cut(place(cut(chosen, "chosen")), "placed")
    chosen = broadcast_if_small(chosen, chosen.count(), 72)
    t = docs[f"`{text}`"].cast("string")
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))
    texts = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))).select("component", "block", "blocks", "item", "size", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(words_of(t), n).tobytes() for t in batch.column(5).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], found], [c.split()[0] for c in schema.split(", ")])
        release(_hashes)

    schema = "component long, block long, blocks long, item long, size long, payload binary"
    payloads = texts.mapInArrow(sets, schema).dropDuplicates(["item"])
    return linked(payloads, lambda p, labels: jaccard_clusters(p, labels, percent))


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    prepare(docs.sparkSession)
    sketches = cut(sketch(docs, n, percent, doc_id, text), "sketch")
    leaders = cut(_leaders(docs, sketches, n, percent, doc_id, text).withColumnRenamed("item", "of"), "leaders")
    classes = sketches.where("size > 0").groupBy("digest", "item").agg(F.min("doc_id").alias("least"))
    joined = classes.join(broadcast_if_small(leaders, leaders.count(), 32), F.col("item") == F.col("of"), "left")
    named = cut(joined.select("digest", "least", F.coalesce("leader", "item").alias("leader"), F.col("leader").isNotNull().alias("joined")), "named")
    by_leader = named.where("joined").groupBy("leader").agg(F.min("least").alias("name"))
    known = named.join(by_leader, "leader", "left").select("digest", F.when(F.col("joined"), F.col("name")).otherwise(F.col("least")).alias("component_id"))
    out = sketches.select("doc_id", "digest", F.col("size").alias("n_shingles")).join(known, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a row before them in their component stands for."""
    prepare(docs.sparkSession)
    sketches = cut(sketch(docs, n, percent, doc_id, text), "sketch")
    leaders = cut(_leaders(docs, sketches, n, percent, doc_id, text).withColumnRenamed("item", "of"), "leaders")
    # counted by row first, so that a group of copies sends few rows to its name
    rows = sketches.where("size > 0").groupBy("item", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows.join(broadcast_if_small(leaders, leaders.count(), 32), F.col("item") == F.col("of"), "left").select(F.coalesce("leader", "item").alias("leader"), F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th").alias("at"), "n"), "rows")
    first = cut(rows.groupBy("leader").agg(F.min("at").alias("first"), F.sum("n").alias("m")).where("m > 1").select(F.col("leader").alias("of"), "first"), "firsts")
    several = rows.join(first, rows["leader"] == first["of"])
    losers = cut(several.where("at <> first").select(F.col("at.doc_id").alias("_k"), F.col("at.th").alias("_h")).distinct(), "losers")
    repeated = cut(several.where("at = first AND n > 1").select(F.col("at.doc_id").alias("_k"), F.col("at.th").alias("_h")), "repeated")
    losers, repeated = (broadcast_if_small(x, x.count(), 32) for x in (losers, repeated))

    own = (docs[f"`{doc_id}`"].cast("long"), F.xxhash64(docs[f"`{text}`"].cast("string")))
    marked = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), own[0].alias("k"), own[1].alias("h"))
    same = lambda x: F.col("k").eqNullSafe(x["_k"]) & (F.col("h") == x["_h"])
    kept = marked.join(losers, same(losers), "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    one = kept.join(repeated, same(repeated), "left_semi").groupBy("k", "h").agg(F.first("row").alias("row"))
    return kept.join(repeated, same(repeated), "left_anti").select("row.*").unionAll(one.select("row.*"))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all `documents` by the Jaccard similarity of 5-word shingles, from 0.75 on."""
    prepare(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLES = {
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id) m USING (doc_id)"""
}
QUERIES = {"op10_ngram_join": ngram_join}

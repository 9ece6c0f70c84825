"""Connected components of documents or lines that a costly test links, without pairs of all members of a group.

`with_totals` tells each row about all rows of its key; `shared_keys` finds the keys that several items have;
`weak_edges` turns such keys into a star for each key; `components` labels what edges connect; and `linked` tests inside
each such weak component, in blocks of bounded size, each of which a function clusters exactly. All but small components
have several blocks, so that none is a single task's work: where blocks give few clusters (a group of copies) their
leaders meet, and the pairs of blocks that then still hold more than one cluster meet whole (texts that share a passage,
say).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import broadcast_if_small, cut, drop, made, release

#: Bytes that the items of a task's block take in memory at most, by the estimate in `size`.
BLOCK_BYTES = 64 << 20
#: Components up to this size are one block; larger ones have at least PARTS blocks, or one for each PART_BYTES if these
#: are fewer. Every pair of blocks may meet, so the more parts, the more often a component's items are sent.
WHOLE_BYTES, PART_BYTES, PARTS = 256 << 10, 64 << 10, 16
#: A key is hot from so many rows on, as seen by one row in DRAWN; the MOST_HOT most frequent ones are dealt apart.
HOT_ROWS, DRAWN, MOST_HOT = 4096, 64, 1024
#: Parts that the rows of a hot key are dealt to by `parted`.
SPREAD = 256
#: Edges up to this number, 1 MB of them, are joined in one task; more take rounds over all tasks.
FEW_EDGES = 1 << 16
#: Bytes of a block from which on a worker gives memory back after it.
LARGE = 4 << 20

#: (items, labels or None) -> labels: items of equal label are linked already; the result has the least index of each cluster.
Cluster = Callable[[list, list[int]], list[int]]


class Sets:
    """Disjoint sets of 0..n-1, each named by its least member."""

    def __init__(self, labels: list[int]):
        self.parent = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            self.union(i, first.setdefault(x, i))

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def union(self, i: int, j: int) -> None:
        i, j = sorted((self.find(i), self.find(j)))
        self.parent[j] = i

    def labels(self) -> list[int]:
        return [self.find(i) for i in range(len(self.parent))]


def draw(rows: DataFrame, *by: str) -> DataFrame:
    """One row in DRAWN, by a hash of these columns: enough to see which keys are hot, and not used for results."""
    return rows.where(F.pmod(F.xxhash64(*by), F.lit(DRAWN)) == 0)


def hot_keys(drawn: DataFrame, key: str) -> DataFrame:
    """(_hot): keys that drawn rows show to have very many, at most MOST_HOT."""
    often = drawn.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * DRAWN >= HOT_ROWS)
    return cut(often.orderBy(F.desc("n"), key).limit(MOST_HOT).select(F.col(key).alias("_hot")), "hot")


def with_totals(rows: DataFrame, key: str, totals: dict[str, Column], hot: DataFrame) -> DataFrame:
    """Rows with aggregates over all rows of their key beside them.

    Most keys are dealt out once, and a window adds up. Those of `hot` (see hot_keys) don't meet in one task: their rows
    are added up partially before the shuffle, and the sums, of at most MOST_HOT keys, are broadcast to the rows where
    these are. A key that is hot but not among those has at most a MOST_HOT-th of all rows.
    """
    dealt = {name: total.over(W.partitionBy(key)) for name, total in totals.items()}
    if hot.isEmpty():
        return rows.withColumns(dealt)
    hot = F.broadcast(hot)  # at most MOST_HOT rows
    cold = rows.join(hot, F.col(key) == F.col("_hot"), "left_anti").withColumns(dealt)
    warm = rows.join(hot, F.col(key) == F.col("_hot"), "left_semi")
    sums = cut(warm.groupBy(F.col(key).alias("_hot")).agg(*[total.alias(name) for name, total in totals.items()]), "sums")
    return cold.unionByName(warm.join(F.broadcast(sums), F.col(key) == F.col("_hot")).drop("_hot"))


def parted(rows: DataFrame, key: str, hot: DataFrame, item: str = "item") -> DataFrame:
    """Rows with `_part`: 0, or for keys of `hot` one of SPREAD numbers from 1 on, by the item.

    What is dealt out by (key, _part) doesn't meet in one task, however hot the key, and all rows go one way: they are
    read once and joined once, with the few keys of `hot`.
    """
    if hot.isEmpty():
        return rows.withColumn("_part", F.lit(0))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")  # at most MOST_HOT rows
    return marked.withColumn("_part", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(item), F.lit(SPREAD)) + 1).cast("int")).drop("_hot")


def shared_keys(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(item, size, key) rows -> the distinct ones of keys that several items have, with `df`, by which keys are ordered.

    It is the number of the key's rows, or for hot keys, whose rows don't meet, a number above all others. A hot key that
    one item alone has may stay: what it leads to is tested.
    """
    of = W.partitionBy("key", "_part")
    totals = {"lo": F.min("item").over(of), "hi": F.max("item").over(of), "df": F.when(F.col("_part") > 0, 1 << 62).otherwise(F.count(F.lit(1)).over(of))}
    several = parted(rows, "key", hot).withColumns(totals).where("_part > 0 OR lo < hi")
    return several.select("item", "size", "key", "_part", "df").distinct().drop("_part")  # with _part, where they are


def _least(rows: DataFrame) -> DataFrame:
    """(k, m): the least b of each a. Written, so that a join with it deals out both sides itself and Spark can split a
    hot node; broadcast where the counted rows are few."""
    least = cut(rows.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"), "least")
    return broadcast_if_small(least, least.count(), 32)


def _joined(edges: DataFrame) -> DataFrame:
    """The components of at most FEW_EDGES edges, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
        if held:
            nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            groups = Sets(list(range(len(nodes))))
            for i, j in at.reshape(2, -1).T.tolist():
                groups.union(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[groups.labels()])], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (node, component), component the least node reachable; nodes without edges don't occur.

    Alternates large-star and small-star steps; each is a minimum by node, partial before the shuffle, and a join back
    that Spark may split at a hot node. What a round makes is written, so a lost executor repeats one round. Where at most
    FEW_EDGES are left, a round costs more than they do, and one task joins them.
    """
    before = made()
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        if now.count() <= FEW_EDGES:
            return _joined(now)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("k", F.least("k", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "edges")
        star = _least(large)
        hops = large.join(star, F.col("a") == F.col("k"))
        small = hops.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(star.select(F.col("k").alias("a"), F.col("m").alias("b")))
        new = cut(small.distinct(), "edges")
        # done when no node is both below another and above one: all edges then lead to components' least nodes
        inner = new.select("a").distinct().join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        manifold = new.groupBy("a").count().where("count > 1")
        now = new
        drop(edges.sparkSession, before)
        if inner.isEmpty() and manifold.isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def weak_edges(shared: DataFrame, hot: DataFrame, key: str = "key", item: str = "item", may_lead: str | None = None) -> DataFrame:
    """(key, item) rows of keys with several items -> star edges (a, b): each key's least item (of those that may lead) to the others.

    Where all may lead, the items of a hot key go to the least one of their part, and these to the key's.
    """
    if may_lead:
        lead = F.min(F.when(F.col(may_lead), F.col(item)))
        return with_totals(shared, key, {"_lead": lead}, hot).select(F.col(item).alias("a"), F.col("_lead").alias("b")).where("b IS NOT NULL AND a <> b").distinct()
    stars = parted(shared, key, hot, item).withColumn("_lead", F.min(item).over(W.partitionBy(key, "_part")))
    stars = cut(stars.select(F.col(key).alias("key"), "_part", F.col(item).alias("a"), F.col("_lead").alias("b")).where("_part > 0 OR a <> b"), "stars")
    leads = stars.where("_part > 0").select("key", "b").distinct()  # at most SPREAD rows a key
    tops = leads.select(F.col("b").alias("a"), F.min("b").over(W.partitionBy("key")).alias("b"))
    return stars.select("a", "b").unionAll(tops).where("a <> b").distinct()


def place(items: DataFrame) -> DataFrame:
    """Add `blocks` and `block` to items (component, item, size, ...), so that no block has much more than BLOCK_BYTES.

    Sizes are added up partially before the shuffle; only components of several blocks are joined back, and those are
    at most as many as blocks.
    """
    total = F.col("total")
    blocks = F.greatest(F.ceil(total / BLOCK_BYTES), F.least(F.lit(PARTS), F.ceil(total / PART_BYTES))).cast("long")
    totals = items.groupBy("component").agg(F.sum("size").alias("total")).where(total > min(WHOLE_BYTES, BLOCK_BYTES))
    wide = cut(totals.select(F.col("component").alias("wide"), blocks.alias("blocks")), "wide")
    wide = broadcast_if_small(wide, wide.count(), 32)
    joined = items.join(wide, items["component"] == wide["wide"], "left").drop("wide")
    joined = joined.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return joined.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")))


def clustered(rows: DataFrame, cluster: Cluster) -> DataFrame:
    """Rows (component, block, blocks, item, leader, size, payload) -> the same without size and payload, each with the
    least item of its cluster as leader; rows of one leader are linked already.

    Blocks are streamed: partitions are sorted by block, and a task holds one block at a time. There can be very many
    small blocks, so none costs more than its rows do.
    """
    names = ["component", "block", "blocks", "item", "leader"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            held.sort(key=lambda r: r[3])
            labels = cluster([r[6] for r in held], [r[4] for r in held])
            done.extend((*r[:4], held[i][3]) for r, i in zip(held, labels, strict=True))
            large = sum(r[5] for r in held) > LARGE
            held.clear()
            if large:
                release()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] != row[:2]:
                    close()
                held.append(row)
            if len(done) > 4096:
                yield flush()
        if held:
            close()
        if done:
            yield flush()

    dealt = rows.select(*names, "size", "payload").repartition("component", "block").sortWithinPartitions("component", "block")
    return dealt.mapInArrow(run, "component long, block long, blocks long, item long, leader long")


def linked(items: DataFrame, cluster: Cluster) -> DataFrame:
    """Items (component, block, blocks, item, size, payload binary) -> (item, leader): clusters inside components, named
    by the least item."""
    items = cut(items, "payloads")
    first = cut(clustered(items.withColumn("leader", F.col("item")), cluster), "clusters")
    wide = first.where("blocks > 1")
    if wide.isEmpty():
        return first.select("item", "leader")
    payload = items.where("blocks > 1").select("item", "size", "payload")

    def merged(now: DataFrame, meeting: DataFrame) -> DataFrame:
        """`now` with the leaders that its own links and those found among the meeting rows give."""
        found = clustered(meeting, cluster).unionByName(now)
        named = components(found.select(F.col("item").alias("a"), F.col("leader").alias("b")).where("a <> b"))
        named = named.select(F.col("node").alias("item"), F.col("component").alias("named"))
        return cut(now.join(named, "item", "left").select("component", "block", "blocks", "item", F.coalesce("named", "leader").alias("leader")), "clusters")

    # leaders of one component meet where they are few
    sized = cut(wide.join(payload.select("item", "size"), "item").groupBy("component").agg(F.sum("size").alias("total"), F.sum(F.when(F.col("item") == F.col("leader"), F.col("size"))).alias("leading")), "sized")
    fit = sized.where((F.col("leading") <= F.greatest(F.lit(WHOLE_BYTES), F.col("total") / 8)) & (F.col("leading") <= BLOCK_BYTES)).select("component")
    leaders = wide.where("item = leader").join(fit, "component", "left_semi").join(payload, "item")
    now = merged(wide, leaders.withColumn("block", F.lit(0).cast("long")))

    # blocks that hold more than one cluster between them meet in pairs
    held = cut(now.groupBy("component", "block").agg(F.min("leader").alias("lo"), F.max("leader").alias("hi")), "held")
    other = held.select("component", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = held.join(other, "component").where("block < block2 AND (lo <> hi OR lo2 <> hi2 OR lo <> lo2)")
    pairs = cut(pairs.select("component", F.explode(F.array("block", "block2")).alias("block"), F.xxhash64("block", "block2").alias("pair")), "pairs")
    if not pairs.isEmpty():
        meeting = now.join(payload, "item").join(broadcast_if_small(pairs, pairs.count(), 32), ["component", "block"])
        now = merged(now, meeting.withColumn("block", F.col("pair")).drop("pair"))
    return first.where("blocks = 1").select("item", "leader").unionAll(now.select("item", "leader"))

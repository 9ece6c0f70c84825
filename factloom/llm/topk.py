"""Operator 4: exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to cells by the sides of the widest dimensions' means that they lie on, and a cell of many vectors to
several shards by a hash of the id, so near vectors share shards and no vector that comes often makes a large one. A
shard's tree splits at the median of the widest dimension and keeps a tight box, and the smallest id, of every node. A
query bounds a node's inner products by its box, takes nodes best first, and stops where no bound can beat its kth
score. That score is propagated: a query first searches its own shard, and carries what it found to those others whose
root box can still beat it; these return only what can be among the k best.

Queries go to the shards in blocks: a task holds one shard and one block, and no task's memory grows with the table.
Root boxes are sent to the tasks where their counted bytes are few; beyond that queries go to all shards.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; rows are
searched for and found as often as they come, so one that repeats an id and a vector is a candidate of the other, and so
are two vectors of one id; scores are between vectors of one length; a query without candidates has no row; extra columns are ignored. Components times 256
must be under 2**26, so that sums stay exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import broadcast_if_small, cut, prepare, table

#: Vectors of a shard, and queries of a block, on average.
SHARD, BLOCK = 16384, 2048
LEAF = 64
SCALE = 256
#: Bytes of root boxes up to which tasks hold them all, and shards of a cell at most.
BOX_BYTES, PARTS = 32 << 20, 1 << 31


class Tree:
    """A KD-tree in arrays; node i's children are 2i+1 and 2i+2, its points order[first[i]:last[i]]."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, times: np.ndarray):
        order = np.arange(len(ids))
        spans, boxes, least = {}, {}, {}
        todo = [(0, 0, len(ids))]
        while todo:
            node, a, b = todo.pop()
            own = points[order[a:b]]
            low, high = own.min(0), own.max(0)
            spans[node], boxes[node], least[node] = (a, b), (low, high), int(ids[order[a:b]].min())
            if b - a > LEAF:
                d = int((high - low).argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, d], middle)]
                todo += [(2 * node + 1, a, a + middle), (2 * node + 2, a + middle, b)]
        self.nodes = np.array(sorted(spans))
        self.place = {int(n): i for i, n in enumerate(self.nodes)}
        self.low = np.array([boxes[n][0] for n in self.nodes])
        self.high = np.array([boxes[n][1] for n in self.nodes])
        self.span = [spans[n] for n in self.nodes]
        self.least = [least[n] for n in self.nodes]
        children = [(self.place.get(2 * int(n) + 1, -1), self.place.get(2 * int(n) + 2, -1)) for n in self.nodes]
        self.children = children
        self.ids, self.points, self.times = ids[order], points[order], times[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the most that a point in the node's box can score."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own_id: int, bounds: np.ndarray, k: int, found: list[tuple]) -> list[tuple]:
        """The k best (score, -id, times, new) of `found` and this tree, as a heap; best-first by bound. `times` counts
        equal rows, `new` tells the tree's from those found before."""
        heap = list(found)
        heapq.heapify(heap)
        root = bounds[0]
        todo = [(-root, 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if len(heap) == k and (-bound, -self.least[node]) < heap[0]:
                if -bound < heap[0][0]:
                    break
                continue
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(todo, (-bounds[left], left))
                heapq.heappush(todo, (-bounds[right], right))
                continue
            a, b = self.span[node]
            scores = self.points[a:b] @ query
            ids, times = self.ids[a:b], self.times[a:b]
            if len(own := np.flatnonzero(ids == own_id)):  # the query's own row counts once less
                times = times.copy()
                times[own] -= (self.points[a:b][own] == query).all(1)
            keep = times > 0
            if len(heap) == k:
                keep &= scores >= heap[0][0]
            for s, i, n in zip(scores[keep].tolist(), ids[keep].tolist(), times[keep].tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i, n, True))
                elif (s, -i) > heap[0][:2]:
                    heapq.heapreplace(heap, (s, -i, n, True))
        return heap


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _keys(df: DataFrame, *names: str) -> DataFrame:
    """Distinct keys, as columns of their own, so that both sides of a cogroup stay apart."""
    return df.select(*[F.col(n).alias(n) for n in names]).distinct()


def _dealt(rows: DataFrame, shard: int) -> DataFrame:
    """Rows (id, v, dim, ...) with `shard`, for about `shard` rows each."""
    cell = F.lit(0).cast("long")
    bits = (max(1, -(-rows.count() // shard)) - 1).bit_length()
    if bits:
        common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
        spread = rows.where(F.col("dim") == common).select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
        for i, r in enumerate(spread.orderBy(F.desc("var"), "d").limit(bits).collect()):
            cell = cell + F.when(F.get("v", F.lit(r["d"])) > r["mean"], F.lit(1 << i)).otherwise(0)
        cell = F.when(F.col("dim") == common, cell).otherwise(0)
    placed = rows.withColumn("cell", cell)
    wide = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("long").alias("parts")).where("parts > 1"), "cells")
    placed = placed.join(broadcast_if_small(wide, wide.count(), 32), "cell", "left")
    return placed.withColumn("shard", F.col("cell") * PARTS + F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("cell", "parts")


def _boxes(near: DataFrame) -> DataFrame:
    """(dim, shard, low, high): the root box of each shard; sides are partial before the shuffle."""
    sides = near.select("dim", "shard", F.posexplode("v").alias("d", "x")).groupBy("dim", "shard", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    box = sides.groupBy("dim", "shard").agg(F.sort_array(F.collect_list(F.struct("d", "low", "high"))).alias("s"))
    return cut(box.select("dim", "shard", F.transform("s", lambda x: x["low"]).alias("low"), F.transform("s", lambda x: x["high"]).alias("high")), "boxes")


def _meeting(first: DataFrame, boxes: DataFrame, k: int) -> DataFrame:
    """Rows of `first` with the other shards that may hold something better than what they have found."""
    size = boxes.agg(F.coalesce(F.sum(16 * F.col("dim")), F.lit(0)).alias("n")).first()["n"]
    if size > BOX_BYTES:
        return first.join(boxes.select("dim", "shard"), "dim").where("shard != home")
    sides = {}
    for r in boxes.collect():  # their bytes are counted above
        sides.setdefault(r["dim"], []).append((r["shard"], r["low"], r["high"]))
    held = {d: (np.array([x[0] for x in s], np.int64), np.array([x[1] for x in s], float), np.array([x[2] for x in s], float)) for d, s in sides.items()}
    sent = first.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                shards, low, high = sent.value[dim]
                found = own["times"].map(sum).to_numpy()
                least = np.array([min(s) if len(s) and n >= k else -np.inf for s, n in zip(own["scores"], found, strict=True)])
                for a in range(0, len(own), 256):
                    part = own.iloc[a : a + 256]
                    q = _matrix(part["qv"])
                    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    at, to = np.nonzero((bounds >= least[a : a + 256, None]) & (shards[None, :] != part["home"].to_numpy()[:, None]))
                    yield part.iloc[at].assign(shard=shards[to])

    return first.mapInPandas(run, T.StructType([*first.schema.fields, T.StructField("shard", T.LongType())]))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For every row for which `queries` (a condition on vec_id) holds, its k best others: query_id, rank, vec_id, score."""
    rows = (
        vectors.where(usable(vectors[vector]) & vectors[vec_id].isNotNull())
        .select(vectors[vec_id].cast("long").alias("id"), F.transform(vectors[vector], lambda x: F.floor(x.cast("double") * SCALE)).alias("v"), queries.alias("q"))
        .groupBy("id", "v", "q")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("dim", F.size("v"))
    )
    rows = cut(_dealt(cut(rows, "vectors"), shard), "dealt")
    blocks = max(1, -(-rows.where("q").count() // block))
    near = rows.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"), F.col("id").alias("id"), F.col("v").alias("v"), F.col("times").alias("times"))
    asked = rows.where("q").select(
        "dim", F.col("shard").alias("home"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("times").alias("asked")
    )
    schema = "dim int, home long, block long, query_id long, qv array<bigint>, asked long, ids array<bigint>, scores array<bigint>, times array<bigint>"

    def search(points: pd.DataFrame, block_rows: pd.DataFrame, carried: bool) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(block_rows) or not len(points) and not carried:
            return pd.DataFrame({n: [] for n in names}) if not len(block_rows) else block_rows.assign(ids=[[]] * len(block_rows), scores=[[]] * len(block_rows), times=[[]] * len(block_rows))[names]
        out_ids, out_scores, out_times = [], [], []
        tree = Tree(points["id"].to_numpy(np.int64), _matrix(points["v"]), points["times"].to_numpy(np.int64)) if len(points) else None
        q = _matrix(block_rows["qv"])
        for a in range(0, len(q), 256):
            bounds = tree.bounds(q[a : a + 256]) if tree else None
            for i in range(a, min(a + 256, len(q))):
                row = block_rows.iloc[i]
                before = [(float(s), -int(x), int(n), False) for s, x, n in zip(row["scores"], row["ids"], row["times"], strict=True)] if carried else []
                heap = tree.search(q[i], int(row["query_id"]), bounds[i - a], k, before) if tree else before
                fresh = [x for x in heap if x[3]]
                out_ids.append([-x[1] for x in fresh])
                out_scores.append([int(x[0]) for x in fresh])
                out_times.append([x[2] for x in fresh])
        return block_rows.assign(ids=out_ids, scores=out_scores, times=out_times)[names]

    first = cut(
        near.withColumnRenamed("shard", "home")
        .join(_keys(asked, "dim", "home", "block"), ["dim", "home"])
        .groupBy("dim", "home", "block")
        .cogroup(asked.groupBy("dim", "home", "block"))
        .applyInPandas(lambda p, b: search(p, b, False), schema),
        "first",
    )
    pairs = cut(_meeting(first, _boxes(near), k), "pairs")
    wanted = near.join(_keys(pairs, "dim", "shard", "block"), ["dim", "shard"])
    rest = wanted.groupBy("dim", "shard", "block").cogroup(pairs.groupBy("dim", "shard", "block")).applyInPandas(lambda p, b: search(p, b.drop(columns="shard"), True), schema)
    both = first.unionByName(rest).select("query_id", "qv", "asked", F.explode(F.arrays_zip("ids", "scores", "times")).alias("x"))
    each = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("x.times"), F.lit(k)).cast("int"))))
    order = W.partitionBy("query_id", "qv").orderBy(F.desc("x.scores"), "x.ids")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # rows that repeat a query get its answers each
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every row of `embeddings` whose vec_id is divisible by 50, the 5 best of all others."""
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLES = {
    "op4_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op4_exact_top_k": exact_top_k}

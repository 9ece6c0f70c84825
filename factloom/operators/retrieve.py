"""Hybrid retrieval: dense and lexical arms, rank fusion, reranking and the final score.

A search has one query (or a short list given by the caller): its vector and terms are literals, so every arm is a scan
with a bounded top-k (TakeOrderedAndProject), no join with the corpus and nothing broadcast that grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import scoring
from factloom.functions.text import plain_term, query_terms, search_tokens
from factloom.functions.vectors import cosine, truncate
from factloom.operators.spine import surface
from factloom.shared import materialized

#: Candidates an arm gives, the pools before checks, the rank offset of the fusion.
ARM, COARSE_POOL, SPARSE_POOL, FUSED, RRF_K = 40, 320, 80, 40, 10
#: Fixed values of BM25, and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def coarse_vector(vector: list[float], dim: int) -> list[float]:
    head = [float(x) for x in vector[:dim]]
    size = math.sqrt(sum(x * x for x in head)) or 1.0
    return [x / size for x in head]


def dense_arm(
    facts: DataFrame, vector: list[float], id: str = "id", embedding: str = "embedding", coarse: str | None = None, coarse_dim: int = 256,
    pool: int | None = COARSE_POOL, k: int = ARM, check: Column | None = None,
) -> DataFrame:
    """(id, distance, dense_rank). With a pool the nearest by truncated vectors come first, and `check` holds after them."""
    if pool is not None:
        near = F.col(coarse) if coarse else truncate(F.col(embedding), coarse_dim)
        score = cosine(near, _literal(coarse_vector(vector, coarse_dim)))
        facts = facts.withColumn("_coarse", F.round(1 - score, 9)).orderBy("_coarse", id).limit(pool)
    if check is not None:
        facts = facts.where(check)
    ranked = facts.select(id, F.round(1 - cosine(F.col(embedding), _literal(vector)), 9).alias("distance")).orderBy("distance", id).limit(k)
    return ranked.withColumn("dense_rank", F.row_number().over(W.orderBy("distance", id)))


def _occurrences(tokens: str, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(word)))


def _weigh(counted: DataFrame, terms: list[str], n: int, size: float, dfs: dict[str, int]) -> DataFrame:
    """Rows (_size, _hits: the query's terms as often as they occur) with `bm25`."""
    parts = []
    for w in terms:
        df = dfs.get(w, 0)
        weight = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
        tf = _occurrences("_hits", w)
        parts.append((weight if weight > 0 else LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_size") / (size or 1.0))))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return counted.where(F.size("_hits") > 0).withColumn("bm25", F.round(total, 9)).drop("_size", "_hits")


def _statistics(counted: DataFrame) -> tuple[int, float]:
    row = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("_size").alias("size")).first()
    return row["n"], row["size"] or 1.0


def _frequencies(counted: DataFrame) -> dict[str, int]:
    """Of each of the query's terms, the documents that hold it."""
    rows = counted.select(F.explode(F.array_distinct("_hits")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in rows.collect()}  # a row for each of the query's terms at most


def bm25_scores(docs: DataFrame, query: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Docs (columns in `carry`, all but the text and vectors by default) that hold a term of the query, with `bm25`.

    Texts are split once: what is kept of each, its length and the terms it shares with the query, is written, and
    statistics and scores are made of that.
    """
    terms = query_terms(query)
    kept = [c for c in docs.columns if c not in (text, "embedding", "coarse")] if carry is None else carry
    if not terms:
        return docs.select(*kept).where("false").withColumn("bm25", F.lit(0.0))
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    split = docs.select(*kept, tokens.alias("_tokens"))
    hits = F.filter(F.transform("_tokens", plain_term), lambda t: t.isin(*terms))
    counted = materialized(split.select(*kept, F.size("_tokens").alias("_size"), hits.alias("_hits")), "terms")
    return _weigh(counted, terms, *_statistics(counted), _frequencies(counted))


def postings(facts: DataFrame, id: str = "id", text: str = "fact_text") -> DataFrame:
    """(namespace, term, fact_id, tf, size) of the text index: a row for each distinct term of a fact, and one of the
    empty term, which tells the fact's length. Texts are single statements, so terms are counted beside the row."""
    tokens = facts.select("namespace", F.col(id).alias("fact_id"), search_tokens(F.col(text)).alias("_tokens"))
    counted = F.transform(F.array_distinct("_tokens"), lambda t: F.struct(t.alias("term"), F.size(F.filter("_tokens", lambda x: x == t)).alias("tf")))
    length = F.array(F.struct(F.lit("").alias("term"), F.size("_tokens").alias("tf")))
    return tokens.select("namespace", "fact_id", F.size("_tokens").alias("size"), F.explode(F.concat(length, counted)).alias("x")).select(
        "namespace", "x.term", "fact_id", "x.tf", "size"
    )


def bm25_of_postings(index: DataFrame, facts: DataFrame, query: str, id: str = "id") -> DataFrame:
    """(id, bm25) of the facts that hold a term of the query, from their postings: only the query's terms are read, and
    lengths for the statistics. `index` and `facts` are of one namespace; statistics are of these facts."""
    terms = query_terms(query)
    if not terms:
        return facts.select(id).where("false").withColumn("bm25", F.lit(0.0))
    ids = facts.select(F.col(id).alias("fact_id"))
    row = index.where("term = ''").join(ids, "fact_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("size")).first()
    own = index.where(F.col("term").isin(*terms)).join(ids, "fact_id", "left_semi")
    held = own.groupBy("fact_id").agg(F.max("size").alias("_size"), F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("_hits"))
    counted = materialized(held.select(F.col("fact_id").alias(id), "_size", "_hits"), "terms")
    return _weigh(counted, terms, row["n"], row["size"] or 1.0, _frequencies(counted))


def sparse_arm(
    docs: DataFrame, query: str, id: str = "id", text: str = "fact_text", pool: int | None = SPARSE_POOL, k: int = ARM, check: Column | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(id, bm25, sparse_rank). With a pool the best of the whole index come first, and `check` holds after them. With
    `index` (see postings) scores are made of stored terms."""
    scored = bm25_scores(docs, query, text, None if check is not None else [id]) if index is None else bm25_of_postings(index, docs, query, id)
    if pool is not None and check is not None:
        scored = scored.orderBy(F.desc("bm25"), id).limit(pool)
    if check is not None:
        scored = (scored if index is None else docs.join(F.broadcast(scored), id) if pool is not None else docs.join(scored, id)).where(check)
    best = scored.select(id, "bm25").orderBy(F.desc("bm25"), id).limit(k)
    return best.withColumn("sparse_rank", F.row_number().over(W.orderBy(F.desc("bm25"), id)))


def fuse(dense: DataFrame, sparse: DataFrame, id: str = "id", k: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion of two arms; ties keep the dense order, then the sparse one."""
    both = dense.select(id, "dense_rank").join(sparse.select(id, "sparse_rank"), id, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    order = [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")]
    fused = both.withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 12)).orderBy(*order).limit(k)
    return fused.withColumn("fused_rank", F.row_number().over(W.orderBy(*order)))


def identity_rerank(fused: DataFrame) -> DataFrame:
    """The default reranker: a ramp down the fused order."""
    return fused.withColumn("relevance_raw", (F.count(F.lit(1)).over(W.partitionBy()) - F.col("fused_rank") + 1).cast("double"))


def rerank(fused: DataFrame, facts: DataFrame, query: str, score: Callable[[str, list[str]], list[float]], id: str = "id", text: str = "fact_text") -> DataFrame:
    """A model's scores of at most FUSED candidates, in Arrow batches; `score` gets the query and texts."""

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([float(s) for s in score(query, texts.to_pylist())], pa.float64())

    rows = facts.select(id, text).join(F.broadcast(fused), id)  # at most FUSED rows
    return rows.withColumn("relevance_raw", scores(F.col(text))).drop(text)


def hits(reranked: DataFrame, facts: DataFrame, now: int, k: int = 5, id: str = "id") -> DataFrame:
    """The k best by the final score; `facts` gives salience, last_access and valid_at of at most FUSED candidates."""
    rows = facts.join(F.broadcast(reranked), id)  # at most FUSED rows
    rows = rows.withColumn("relevance", scoring.minmax(F.col("relevance_raw"), W.partitionBy()))
    rows = rows.withColumn("recency", scoring.recency(F.col("last_access"), F.col("valid_at"), now)).withColumn("importance", F.col("salience") / 10.0)
    rows = rows.withColumn("final_score", F.round(scoring.final_score(F.col("relevance"), F.col("recency"), F.col("salience")), 9))
    return rows.orderBy(F.desc("final_score"), "fused_rank").limit(k)


def search(
    facts: DataFrame, query: str, vector: list[float], now: int, k: int = 5, as_of: int | None = None, is_latest_only: bool = True,
    include_cold: bool = False, pool: str = "exact", coarse_dim: int = 256, index: DataFrame | None = None,
    model: Callable[[str, list[str]], list[float]] | None = None,
) -> DataFrame:
    """Hybrid search over the fact view. pool="exact" filters before the arms; "parity" keeps the bounded pools. `index`
    holds the facts' postings, if they are stored; `model` scores the fused candidates."""
    visible = surface(facts, as_of, is_latest_only, include_cold)
    if pool == "parity":
        check = F.lit(True) if as_of is None else (F.col("valid_at") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") > as_of))
        dense = dense_arm(surface(facts, None, is_latest_only, include_cold or as_of is not None), vector, coarse_dim=coarse_dim, check=check)
        allowed = F.lit(True)
        if is_latest_only:
            allowed = F.col("is_latest") == 1
            if as_of is None and not include_cold:
                allowed = allowed & (F.col("tier") == "hot")
        sparse = sparse_arm(facts, query, check=allowed & check, index=index)
    else:
        dense = dense_arm(visible, vector, pool=None)
        sparse = sparse_arm(visible, query, pool=None, index=index)
    fused = fuse(dense, sparse)
    return hits(identity_rerank(fused) if model is None else rerank(fused, visible, query, model), visible, now, k)


def touches(found: DataFrame, now: int) -> DataFrame:
    """The events that a search leaves on its hits, for the caller to append."""
    return found.select(F.col("id").alias("fact_id"), F.lit("touch").alias("kind"), F.lit(now).alias("at_ms"))


def best_bullets(rows: DataFrame, by: list[str], rank: str) -> DataFrame:
    """One row for each distinct value of `by`, the best ranked."""
    best = W.partitionBy(*by).orderBy(rank)
    return rows.withColumn("_first", F.row_number().over(best)).where("_first = 1").drop("_first")

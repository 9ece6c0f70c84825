"""Queries of the retrieval arms. Query vectors are literals computed from a fixed rule, known to both sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import scoring
from factloom.functions.vectors import cosine, truncate
from factloom.operators import retrieve
from factloom.plans.inputs import EVENTS, NOW, event_facts, table

DIM, COARSE = 64, 16
QUERY_VECTOR = [round(math.sin(i + 1), 6) for i in range(DIM)]
QUERY = "the anon thor of heeat reed dieein"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("fact_text"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.dense_arm(_vectors(spark, sf_dir), QUERY_VECTOR, pool=None)
    return found.select("id", F.round("distance", 6).alias("distance"), F.col("dense_rank").cast("long").alias("dense_rank"))


def matryoshka_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = cosine(truncate(F.col("embedding"), COARSE), F.array(*map(F.lit, retrieve.coarse_vector(QUERY_VECTOR, COARSE))))
    return _vectors(spark, sf_dir).select("id", F.round(near, 6).alias("coarse_cosine"))


def two_stage_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.dense_arm(_vectors(spark, sf_dir), QUERY_VECTOR, coarse_dim=COARSE, pool=80)
    return found.select("id", F.round("distance", 6).alias("distance"), F.col("dense_rank").cast("long").alias("dense_rank"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.sparse_arm(_documents(spark, sf_dir), QUERY)
    return found.select("id", F.round("bm25", 6).alias("bm25"), F.col("sparse_rank").cast("long").alias("sparse_rank"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = retrieve.dense_arm(_vectors(spark, sf_dir), QUERY_VECTOR, pool=None)
    return retrieve.fuse(dense, retrieve.sparse_arm(_documents(spark, sf_dir), QUERY, pool=None))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("id", F.round("rrf", 9).alias("rrf"), F.col("fused_rank").cast("long").alias("fused_rank"))


def minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieve.identity_rerank(_fused(spark, sf_dir))
    return ranked.select("id", F.round(scoring.minmax(F.col("relevance_raw"), W.partitionBy()), 9).alias("relevance"))


def decay_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = event_facts(spark, sf_dir)
    return facts.select("id", F.round(scoring.recency(F.col("last_access"), F.col("valid_at"), NOW), 9).alias("recency"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms over documents and their vectors; times, salience and usage are those of the events with their ids."""
    events = event_facts(spark, sf_dir).select("id", "valid_at", "last_access", "salience")
    found = retrieve.hits(retrieve.identity_rerank(_fused(spark, sf_dir)), events, NOW, k=10)
    return found.select("id", F.col("fused_rank").cast("long").alias("fused_rank"), F.round("relevance", 6).alias("relevance"), F.round("final_score", 6).alias("final_score"))


def touch_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of facts by their touches: each event touches the fact of its user."""
    rows = event_facts(spark, sf_dir)
    return rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("valid_at").alias("last_access"))


def search_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_facts(spark, sf_dir).select("namespace", "fact_text", F.col("id").alias("rank"))
    return retrieve.best_bullets(rows, ["namespace", "fact_text"], "rank")


_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_C = "[" + ", ".join(f"{x!r}::DOUBLE" for x in retrieve.coarse_vector(QUERY_VECTOR, COARSE)) + "]"
#: The query's terms, spelled out for SQL.
_TERMS = ["the", "anon", "thor", "of", "heeat", "reed", "dieein"]
_VEC = "ve AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


_DENSE = f"""{_VEC},
dn AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS dense_rank FROM (SELECT id, round(1 - {_cos("e", _Q)}, 9) AS distance FROM ve) ORDER BY distance, id LIMIT 40)"""
_SPARSE_ALL = f"""tk AS (SELECT doc_id AS id, list_filter(string_split_regex(strip_accents(lower(coalesce(text, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS size FROM tk),
tf AS (SELECT id, len(ts) AS size, w, len(list_filter(ts, lambda t: t = w)) AS tf FROM tk, (SELECT unnest({_TERMS}) AS w)),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w),
bm AS (
  SELECT id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.size / st.size))), 9) AS bm25
  FROM tf JOIN df USING (w), st WHERE tf > 0 GROUP BY id)"""
_SPARSE = f"""{_SPARSE_ALL},
sp AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS sparse_rank FROM bm ORDER BY bm25 DESC, id LIMIT 40)"""
_FUSED = f"""{_DENSE}, {_SPARSE},
fj AS (SELECT id, dense_rank, sparse_rank, round(coalesce(1.0::DOUBLE / (10 + dense_rank), 0) + coalesce(1.0::DOUBLE / (10 + sparse_rank), 0), 12) AS rrf FROM dn FULL JOIN sp USING (id)),
fu AS (SELECT id, rrf, row_number() OVER (ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM fj QUALIFY fused_rank <= 40),
mm AS (SELECT id, fused_rank, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (count(*) OVER () - fused_rank)::DOUBLE / (count(*) OVER () - 1) END AS relevance FROM fu)"""
_RECENCY = f"exp(-greatest(0, {NOW} - coalesce(nullif(last_access, 0), valid_at))::DOUBLE / {30 * 86_400_000})"
QUERIES = {
    f.__name__: f
    for f in (
        cosine_topk, matryoshka_coarse, two_stage_knn, bm25_topk, rrf_fusion, minmax_rerank, decay_score, hybrid_search, touch_usage, search_bullets,
    )
}
ORACLES = {
    "cosine_topk": f"WITH {_DENSE} SELECT id, round(distance, 6) AS distance, dense_rank FROM dn",
    "matryoshka_coarse": f"WITH {_VEC} SELECT id, round({_cos(f'e[1:{COARSE}]', _C)}, 6) AS coarse_cosine FROM ve",
    "two_stage_knn": f"""WITH {_VEC}, po AS (SELECT id, e FROM ve ORDER BY round(1 - {_cos(f'e[1:{COARSE}]', _C)}, 9), id LIMIT 80),
sc AS (SELECT id, round(1 - {_cos('e', _Q)}, 9) AS distance FROM po)
SELECT id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, id) AS dense_rank FROM sc QUALIFY dense_rank <= 40""",
    "bm25_topk": f"WITH {_SPARSE} SELECT id, round(bm25, 6) AS bm25, sparse_rank FROM sp",
    "rrf_fusion": f"WITH {_FUSED} SELECT id, round(rrf, 9) AS rrf, fused_rank FROM fu",
    "minmax_rerank": f"WITH {_FUSED} SELECT id, round(relevance, 9) AS relevance FROM mm",
    "decay_score": f"WITH {EVENTS} SELECT id, round({_RECENCY}, 9) AS recency FROM ev",
    "hybrid_search": f"""WITH {EVENTS}, {_FUSED},
jo AS (SELECT id, fused_rank, valid_at, last_access, salience, count(*) OVER () - fused_rank AS raw FROM fu JOIN ev USING (id)),
fs AS (SELECT *, CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 1.0 ELSE (raw - min(raw) OVER ())::DOUBLE / (max(raw) OVER () - min(raw) OVER ()) END AS relevance FROM jo)
SELECT id, fused_rank, round(relevance, 6) AS relevance, round(final, 6) AS final_score
FROM (SELECT *, round(0.6 * relevance + 0.2 * {_RECENCY} + 0.2 * salience / 10, 9) AS final FROM fs) ORDER BY final DESC, fused_rank LIMIT 10""",
    "touch_usage": f"WITH {EVENTS} SELECT subject_id, count(*) AS access_count, max(valid_at) AS last_access FROM ev GROUP BY subject_id",
    "search_bullets": f"WITH {EVENTS} SELECT namespace, fact_text, min(id) AS rank FROM ev GROUP BY ALL",
}

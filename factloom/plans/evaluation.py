"""Queries of the evaluation statistics. Gold labels are `labels.quality`; a rule on the text predicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluate
from factloom.plans.inputs import table


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the rule's prediction: few marks of shouting or tables."""
    docs = table(spark, sf_dir, "documents")
    marks = F.length("text") - F.length(F.regexp_replace("text", "[|!#*$%&]", ""))
    rows = docs.select("doc_id", "lang", (100 * marks < 2 * F.length("text")).cast("int").alias("pred"))
    return table(spark, sf_dir, "labels").join(rows, "doc_id").select("doc_id", "lang", F.col("quality").alias("gold"), "pred")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir))


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(evaluate.confusion(_judged(spark, sf_dir))).select(F.round("macro_f1", 9).alias("macro_f1"))


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_judged(spark, sf_dir), 0).select(F.round("recall", 9).alias("recall"))


def _correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).withColumn("correct", F.col("gold") == F.col("pred"))


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_correct(spark, sf_dir), "correct").select("wins", "n", *[F.round(c, 9).alias(c) for c in ("rate", "lo", "hi")])


def acc_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_correct(spark, sf_dir), "correct", "lang").select("lang", "wins", "n", *[F.round(c, 9).alias(c) for c in ("rate", "lo", "hi")])


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile interval of the macro-F1 over 1000 resamples."""
    return evaluate.bootstrap(_judged(spark, sf_dir), ["gold", "pred"], lambda d: evaluate.macro_f1(d, by=["replicate"]).withColumnRenamed("macro_f1", "value"))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule, and a second arm that calls every document good."""
    return _judged(spark, sf_dir).withColumn("other", F.lit(1))


def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of macro-F1 and of accuracy between two arms on the same cases."""
    cells = _arms(spark, sf_dir).groupBy("gold", "pred", "other").agg(F.count(F.lit(1)).alias("n"))
    right = cells.withColumns({"a": F.col("gold") == F.col("pred"), "b": F.col("gold") == F.col("other")})
    named = lambda df, name: df.select(F.lit(name).alias("statistic"), F.round("value", 6).alias("value"))
    return named(evaluate.f1_delta(cells, "pred", "other"), "macro_f1").unionByName(named(evaluate.accuracy_delta(right, "a", "b"), "accuracy"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of these differences over 1000 resamples that both arms share."""
    arms = _arms(spark, sf_dir)
    f1 = evaluate.bootstrap(arms, ["gold", "pred", "other"], lambda d: evaluate.f1_delta(d, "pred", "other", by=["replicate"]))
    right = arms.select((F.col("gold") == F.col("pred")).alias("a"), (F.col("gold") == F.col("other")).alias("b"))
    share = evaluate.bootstrap(right, ["a", "b"], lambda d: evaluate.accuracy_delta(d, "a", "b", ["replicate"]))
    return f1.select(F.lit("macro_f1").alias("statistic"), "lo", "hi").unionByName(share.select(F.lit("accuracy").alias("statistic"), "lo", "hi"))


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return evaluate.nearest_rank(rows, "value", 0.95, ["event_type"]).unionByName(
        evaluate.nearest_rank(rows.withColumn("event_type", F.concat(F.lit("p50 "), "event_type")), "value", 0.5, ["event_type"])
    )


def judge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, whose gold is their first word; documents of the same id as hypotheses."""
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.get(F.split("text", " "), F.lit(0)).alias("gold"))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("hypothesis"))
    return gold.join(said, "question_id").select("question_id", evaluate.judge_contains(F.col("gold"), F.col("hypothesis")).alias("label"))


def judge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient minus strict accuracy: the gold word in any case against in its own."""
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.get(F.split("text", " "), F.lit(0)).alias("gold"))
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("hypothesis"))
    rows = gold.join(said, "question_id")
    lenient, strict = F.avg(evaluate.judge_contains(F.col("gold"), F.col("hypothesis")).cast("double")), F.avg(F.contains("hypothesis", "gold").cast("double"))
    return rows.agg(F.round(lenient - strict, 9).alias("gap"))


_JUDGED = """ju AS (SELECT l.doc_id, d.lang, l.quality AS gold, (100 * (length(text) - length(regexp_replace(text, '[|!#*$%&]', '', 'g'))) < 2 * length(text))::INT AS pred FROM labels l JOIN documents d USING (doc_id))"""


def _wilson(wins: str, n: str) -> str:
    p = f"({wins}::DOUBLE / {n})"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0::DOUBLE * {n} * {n})) / (1 + 3.8416 / {n}::DOUBLE)"
    centre = f"({p} + 3.8416 / (2.0::DOUBLE * {n})) / (1 + 3.8416 / {n}::DOUBLE)"
    return f"round({p}, 9) AS rate, round(greatest(0, {centre} - {half}), 9) AS lo, round(least(1, {centre} + {half}), 9) AS hi"


QUERIES = {f.__name__: f for f in (confusion, macro_f1, recall, wilson_ci, acc_by_type, bootstrap_ci, paired_delta, paired_bootstrap, percentile_nearest, judge_join, judge_gap)}
ORACLES = {
    "confusion": f"WITH {_JUDGED} SELECT gold, pred, count(*) AS n FROM ju GROUP BY ALL",
    "macro_f1": f"""WITH {_JUDGED}, g AS (SELECT gold AS label, count(*) AS s, sum((gold = pred)::INT) AS tp FROM ju GROUP BY 1), p AS (SELECT pred AS label, count(*) AS p FROM ju GROUP BY 1)
SELECT round(avg(2.0::DOUBLE * tp / (s + coalesce(p, 0))), 9) AS macro_f1 FROM g LEFT JOIN p USING (label)""",
    "recall": f"WITH {_JUDGED} SELECT round(avg((pred = 0)::INT::DOUBLE), 9) AS recall FROM ju WHERE gold = 0",
    "wilson_ci": f"WITH {_JUDGED}, c AS (SELECT count_if(gold = pred)::BIGINT AS wins, count(*) AS n FROM ju) SELECT wins, n, {_wilson('wins', 'n')} FROM c",
    "acc_by_type": f"WITH {_JUDGED}, c AS (SELECT lang, count_if(gold = pred)::BIGINT AS wins, count(*) AS n FROM ju GROUP BY lang) SELECT lang, wins, n, {_wilson('wins', 'n')} FROM c",
    "paired_delta": f"""WITH {_JUDGED}, ar AS (SELECT gold, pred AS p, 'a' AS arm FROM ju UNION ALL SELECT gold, 1, 'b' FROM ju),
g AS (SELECT arm, gold AS label, count(*) AS s, sum((gold = p)::INT) AS tp FROM ar GROUP BY ALL), p AS (SELECT arm, p AS label, count(*) AS n FROM ar GROUP BY ALL),
f AS (SELECT arm, avg(2.0::DOUBLE * tp / (s + coalesce(n, 0))) AS f1 FROM g LEFT JOIN p USING (arm, label) GROUP BY arm)
SELECT 'macro_f1' AS statistic, round(100 * (max(CASE WHEN arm = 'a' THEN f1 END) - max(CASE WHEN arm = 'b' THEN f1 END)), 6) AS value FROM f
UNION ALL SELECT 'accuracy', round(avg((gold = pred)::INT::DOUBLE) - avg((gold = 1)::INT::DOUBLE), 6) FROM ju""",
    "percentile_nearest": """
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[1 + round_even(0.95 * (len(v) - 1), 0)::BIGINT] AS value FROM s UNION ALL SELECT 'p50 ' || event_type, v[1 + round_even(0.5 * (len(v) - 1), 0)::BIGINT] FROM s""",
    "judge_join": "SELECT item_id AS question_id, contains(lower(d.text), lower(string_split(b.text, ' ')[1])) AS label FROM benchmark b JOIN documents d ON d.doc_id = b.item_id",
    "judge_gap": """
SELECT round(avg(contains(lower(d.text), lower(string_split(b.text, ' ')[1]))::INT::DOUBLE) - avg(contains(d.text, string_split(b.text, ' ')[1])::INT::DOUBLE), 9) AS gap
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""",
}

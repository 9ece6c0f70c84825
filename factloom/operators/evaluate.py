"""Evaluation statistics as aggregations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(counts: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """The mean F1 of classes that the gold labels have, from a confusion table."""
    by = by or []
    hit = F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)
    of_gold = counts.groupBy(*by, F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    of_pred = counts.groupBy(*by, F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    joined = of_gold.join(of_pred, [*by, "label"], "left")
    f1 = 2 * F.col("tp") / (F.col("support") + F.coalesce("predicted", F.lit(0)))
    return joined.groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def recall(rows: DataFrame, label: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    hit = F.count_if((F.col(gold) == label) & (F.col(pred) == label))
    return rows.agg(F.coalesce(hit / F.nullif(F.count_if(F.col(gold) == label), F.lit(0)), F.lit(0.0)).alias("recall"))


def wilson(wins: Column, total: Column, z: float = 1.96) -> Column:
    """(rate, lo, hi) of a binomial share; zeros where there are no trials."""
    p = wins / total
    denom = 1 + z * z / total
    centre = (p + z * z / (2 * total)) / denom
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denom
    some = F.struct(p.alias("rate"), F.greatest(F.lit(0.0), centre - half).alias("lo"), F.least(F.lit(1.0), centre + half).alias("hi"))
    none = F.struct(F.lit(0.0).alias("rate"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    return F.when(total > 0, some).otherwise(none)


def accuracy(rows: DataFrame, correct: str, by: str | None = None) -> DataFrame:
    found = rows.groupBy(*([by] if by else [])).agg(F.count_if(correct).alias("wins"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("ci", wilson(F.col("wins"), F.col("n"))).select(*([by] if by else []), "wins", "n", "ci.rate", "ci.lo", "ci.hi")


def bootstrap(rows: DataFrame, cells: list[str], statistic: Callable[[DataFrame], DataFrame], n: int = 1000, seed: int = 20260620) -> DataFrame:
    """(lo, hi): the percentile interval of a statistic over n resamples of the rows.

    Rows count by the columns in `cells` alone, so they are added up by these first, and each replicate draws how often a
    cell occurs from a Poisson distribution of its count: the sum of one draw a row. All that is kept is n rows a cell,
    whatever the table's size. `statistic` maps (replicate, cells, n) to (replicate, value); arms that share cells share
    the draws, which makes differences of theirs paired.
    """

    @F.arrow_udf(T.LongType())
    def drawn(counts: pa.Array, key: pa.Array) -> pa.Array:
        pairs = zip(counts.to_pylist(), key.to_pylist(), strict=True)
        return pa.array([int(np.random.default_rng(k & ((1 << 63) - 1)).poisson(c)) for c, k in pairs], pa.int64())

    counts = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("count"))
    each = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    each = each.withColumn("n", drawn("count", F.xxhash64(F.lit(seed), "replicate", *cells))).where("n > 0").drop("count")
    values = statistic(each)
    place = lambda share: F.least(F.size("v") - 1, F.floor(share * F.size("v")).cast("int"))
    ranked = values.agg(F.sort_array(F.collect_list("value")).alias("v"))  # n values
    return ranked.select(F.get("v", place(0.025)).alias("lo"), F.get("v", place(0.975)).alias("hi"))


def f1_delta(rows: DataFrame, pred: str, other: str, gold: str = "gold", by: list[str] | None = None) -> DataFrame:
    """(by, value): macro-F1 of `pred` less that of `other` over rows (gold, pred, other, n), in hundredths."""
    by = by or []
    arm = lambda c: macro_f1(rows.groupBy(*by, gold, F.col(c).alias("_pred")).agg(F.sum("n").alias("n")), gold, "_pred", by)
    one, two = arm(pred), arm(other).withColumnRenamed("macro_f1", "_other")
    both = one.join(two, by) if by else one.join(F.broadcast(two))  # without `by` two single rows
    return both.select(*by, (100 * (F.col("macro_f1") - F.col("_other"))).alias("value"))


def accuracy_delta(rows: DataFrame, correct: str, other: str, by: list[str] | None = None) -> DataFrame:
    """(by, value): the share of rows (correct, other, n) that `correct` has right, less that of `other`."""
    right = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.groupBy(*(by or [])).agg(((right(correct) - right(other)) / F.sum("n")).alias("value"))


def nearest_rank(rows: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The value at place round(p * (n - 1)), halves to even, of each group's sorted values.

    Equal values are counted before they are ordered, and the place is found in running counts.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*by)
    placed = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    place = F.bround(p * (F.col("n") - 1), 0).cast("long")
    return placed.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*by, F.col(value).alias("value"))


def judge_contains(gold: Column, hypothesis: Column) -> Column:
    """The offline judge: the gold answer occurs in the hypothesis, in any case."""
    return F.contains(F.lower(hypothesis), F.lower(gold))


def truncate_gold(category: Column, answer: Column) -> Column:
    return F.when((category == 3) & F.contains(answer, F.lit(";")), F.trim(F.substring_index(answer, ";", 1))).otherwise(answer)


def parse_label(out: Column) -> Column:
    """True or false by a JSON label, else by the one word that occurs; null where that is unclear."""
    label = F.upper(F.regexp_extract(out, r'(?i)"label"\s*:\s*"(CORRECT|WRONG)"', 1))
    up = F.upper(out)
    right, wrong = F.contains(F.replace(up, F.lit("INCORRECT"), F.lit("")), F.lit("CORRECT")), F.contains(up, F.lit("WRONG"))
    return F.when(label != "", label == "CORRECT").when(right != wrong, right)


def transcript(turns: DataFrame, by: str, seq: str, speaker: str, text: str, at_ms: str) -> DataFrame:
    """Each unit's turns as dated lines, in order."""
    own = F.when(F.startswith(F.col(text), F.concat(F.col(speaker), F.lit(":"))), F.col(text)).otherwise(F.concat(F.col(speaker), F.lit(": "), F.col(text)))
    line = F.concat(F.lit("["), F.date_format(F.timestamp_millis(F.col(at_ms)), "yyyy-MM-dd"), F.lit("] "), own)
    lines = turns.select(by, F.struct(F.col(seq).alias("s"), line.alias("l")).alias("x"))
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("transcript"))


def render_prompt(hits: DataFrame, question: str, rank: str = "rank") -> DataFrame:
    """The reader's prompt: dated facts in ranked order, then the question."""
    line = F.concat(F.lit("- ["), F.date_format(F.timestamp_millis(F.col("valid_at")), "yyyy-MM-dd"), F.lit("] "), F.col("fact_text"))
    lines = hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), line.alias("l")))), lambda x: x["l"]), "\n").alias("block"))
    block = F.coalesce(F.nullif(F.col("block"), F.lit("")), F.lit("(no facts retrieved)"))
    return lines.select(F.concat(block, F.lit(f"\n\nQuestion: {question}")).alias("prompt"))

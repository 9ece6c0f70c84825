"""Bootstrap intervals against resampling case by case."""

import random

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import evaluate


def macro_f1(gold, pred):
    out = []
    for c in sorted(set(gold)):
        tp = sum(g == p == c for g, p in zip(gold, pred, strict=True))
        out.append(2 * tp / (gold.count(c) + pred.count(c)))
    return sum(out) / len(out)


def test_intervals_are_those_of_resampled_cases(spark):
    rng = random.Random(1)
    gold = [rng.choice("aab") for _ in range(300)]
    pred = [g if rng.random() < 0.8 else "b" for g in gold]
    other = [g if rng.random() < 0.6 else "a" for g in gold]
    rows = spark.createDataFrame(list(zip(gold, pred, other, strict=True)), "gold string, pred string, other string")
    draw = np.random.default_rng(2)
    f1s, deltas = [], []
    for _ in range(400):
        pick = draw.integers(0, 300, 300)
        g, p, o = ([x[i] for i in pick] for x in (gold, pred, other))
        f1s.append(macro_f1(g, p))
        deltas.append(100 * (macro_f1(g, p) - macro_f1(g, o)))
    one = evaluate.bootstrap(rows, ["gold", "pred"], lambda d: evaluate.macro_f1(d, by=["replicate"]).withColumnRenamed("macro_f1", "value")).first()
    assert abs(one["lo"] - np.quantile(f1s, 0.025)) < 0.02 and abs(one["hi"] - np.quantile(f1s, 0.975)) < 0.02
    paired = evaluate.bootstrap(rows, ["gold", "pred", "other"], lambda d: evaluate.f1_delta(d, "pred", "other", by=["replicate"])).first()
    assert abs(paired["lo"] - np.quantile(deltas, 0.025)) < 2 and abs(paired["hi"] - np.quantile(deltas, 0.975)) < 2
    cells = rows.groupBy("gold", "pred", "other").agg(F.count(F.lit(1)).alias("n"))
    assert abs(evaluate.f1_delta(cells, "pred", "other").first()["value"] - 100 * (macro_f1(gold, pred) - macro_f1(gold, other))) < 1e-9

"""Operator 3: a quality classifier of naive Bayes support vectors.

A text's features are indicators of n-grams: its words, pairs of words, and 2- and 3-grams of word shapes (letter case,
digits and marks, runs shortened), all of whole texts and whole words. Each indicator is scaled by its class log-count ratio, and a linear hinge-loss
model is fitted to the scaled indicators by dual coordinate descent. A sigmoid fitted to margins of held-out folds turns
a margin into a score.

Fitting takes at most MAX_TRAIN labelled rows, those of the smallest hashes of doc_id; their features, of whole texts,
come to the driver, so its memory is bounded by that parameter. Scoring is one pass over the documents without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias; labels other than 0 and 1, null
ones and those of missing documents aren't learned from; a document with contrary labels counts as its smallest label;
with labels of one class or none every score is that class's share (0.5 without labels); repeated rows score alike; an
empty table gives no row; extra columns are kept by `score`, which replaces one that has the result's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import prepare, release, table

#: Labelled rows that are learned from, at most.
MAX_TRAIN = 4000
#: An n-gram is learned when it occurs in so many of these.
MIN_DOCUMENTS = 5
FOLDS, EPOCHS, COST = 3, 12, 0.05
#: Words that a worker keeps the codes of.
KEPT_WORDS = 120_000


def shape(word: str) -> str:
    """Letter case, digits and marks of a word, with runs shortened: "Thhaen," is "Aa,"; "RE!!!" is "A!!"."""
    out: list[str] = []
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isnumeric() else c
        if not out or out[-1] != k or k not in "Aa0" and out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


class _Words(dict):
    """word -> index into the arrays of word and shape codes; cleared when it's full."""

    def __init__(self):
        super().__init__()
        self.codes = np.zeros(1 << 16, np.int64)
        self.shapes = np.zeros(1 << 16, np.int64)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.codes):
            self.codes, self.shapes = np.resize(self.codes, 2 * i), np.resize(self.shapes, 2 * i)
        self.codes[i] = xxhash.xxh3_64_intdigest(word.encode(), 1) - (1 << 63)
        self.shapes[i] = xxhash.xxh3_64_intdigest(shape(word).encode(), 2) - (1 << 63)
        self[word] = i
        return i


_words = _Words()
#: Odd factors that join codes of neighbouring words and shapes.
_A, _B, _C = np.int64(0x1E3779B97F4A7C15), np.int64(0x42B2AE3D27D4EB4F), np.int64(0x5851F42D4C957F2D)


def features(text: str | None) -> np.ndarray:
    """The distinct n-grams of a whole text, as 64-bit hashes in ascending order."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_words) > KEPT_WORDS:
        _words.clear()
    at = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    codes, shapes = _words.codes[at], _words.shapes[at]
    with np.errstate(over="ignore"):
        pairs = codes[1:] * _C + codes[:-1]
        two = shapes[1:] * _A + shapes[:-1]
        three = two[1:] * _B + shapes[:-2]
    return np.unique(np.concatenate([codes, pairs, np.unique(two), np.unique(three)]))


@dataclass
class Model:
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, found: np.ndarray) -> float:
        if not len(self.grams) or not len(found):
            return self.bias
        at = np.searchsorted(self.grams, found)
        at[at == len(self.grams)] = 0
        return self.bias + float(self.weights[at[self.grams[at] == found]].sum())

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def _ratios(rows: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """log of (share of class 1's counts) over (share of class 0's), with one added to each count."""
    counts = np.ones((2, n))
    for r, y in zip(rows, labels, strict=True):
        counts[int(y > 0), r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; each class has the same total cost."""
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    most = {y: COST * len(rows) / (2 * max(1, (labels == y).sum())) for y in (1, -1)}
    norms = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r, y = rows[i], labels[i]
            values = scale[r]
            gradient = y * (float(weights[r] @ values) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[y])
            if step := (new - alpha[i]) * y:
                alpha[i] = new
                weights[r] += step * values
                bias += step
    return weights, bias


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets."""
    up, down = (labels > 0).sum(), (labels < 0).sum()
    targets = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (targets - p))
        at += step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(found: list[np.ndarray], quality: list[int]) -> Model:
    """Fit to texts' features and their labels 0 or 1."""
    labels = np.where(np.array(quality) > 0, 1, -1)
    if len(set(labels.tolist())) < 2:
        share = 0.5 if not len(labels) else float(labels[0] > 0)
        return Model(slope=0.0, shift=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    grams = np.concatenate(found)
    grams.sort()
    # a text names an n-gram once, so one that occurs often enough is equal to what stands MIN_DOCUMENTS - 1 places on
    often = grams[MIN_DOCUMENTS - 1 :] == grams[: len(grams) - MIN_DOCUMENTS + 1]
    grams = np.unique(grams[: len(often)][often])
    rows = []
    for f in found:
        at = np.searchsorted(grams, f)
        at[at == len(grams)] = 0
        rows.append(at[grams[at] == f] if len(grams) else at[:0])
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        own = [i for i in range(len(rows)) if i % FOLDS != k]
        scale = _ratios([rows[i] for i in own], labels[own], len(grams))
        weights, bias = _descend([rows[i] for i in own], labels[own], scale, k)
        for i in range(k, len(rows), FOLDS):
            margins[i] = float(weights[rows[i]] @ scale[rows[i]]) + bias
    scale = _ratios(rows, labels, len(grams))
    weights, bias = _descend(rows, labels, scale, FOLDS)
    slope, shift = _sigmoid(margins, labels)
    used = weights != 0
    return Model(grams[used], (weights * scale)[used], bias, slope, shift)


def learn(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = MAX_TRAIN) -> Model:
    """Fit to the labelled rows for which `use` (a condition on the labels) holds, at most `most`."""

    @F.arrow_udf(T.BinaryType())
    def grams(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).tobytes() for t in texts.to_pylist()], pa.binary())

    marked = (
        labels.where(use & labels[label].isin(0, 1) & labels[doc_id].isNotNull())
        .groupBy(labels[doc_id].cast("long").alias("_k"))
        .agg(F.min(labels[label].cast("int")).alias("_y"))
        .orderBy(F.xxhash64("_k"), "_k")
        .limit(most)
    )
    texts = docs.select(docs[doc_id].cast("long").alias("_k"), docs[text].alias("_t"))
    # at most `most` rows are sent to all executors; of rows that repeat an id one is taken before any come back
    found = texts.join(F.broadcast(marked), "_k").select("_k", "_y", grams("_t").alias("f"))
    rows = found.groupBy("_k", "_y").agg(F.max("f").alias("f")).toArrow().sort_by("_k")
    return fit([np.frombuffer(x.as_buffer(), np.int64) for x in rows["f"]], rows["_y"].to_pylist())


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score, from 0 to 1, of each whole text. The model, of MAX_TRAIN rows' n-grams, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for texts in batches:
            yield pa.array([own.score(features(t)) for t in texts.to_pylist()], pa.float64())
        release(_words)

    return docs.withColumn(into, scores(docs[f"`{text}`"]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def quality_model(spark: SparkSession, sf_dir: str) -> Model:
    """Learned from `labels.quality` outside the held-out third."""
    labels = table(spark, sf_dir, "labels")
    return learn(table(spark, sf_dir, "documents"), labels, ~held_out(labels["doc_id"]))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text of `documents`."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(spark, sf_dir))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


ORACLES: dict[str, str] = {}
QUERIES = {"op3_quality_classifier": quality_classifier}

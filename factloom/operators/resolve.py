"""Slot folding: what each new fact does to the facts its slot holds.

The fold isn't associative (whether a fact is a restatement depends on what is current), so it is a state machine over
each slot's facts in order. Facts are dealt by slot and sorted inside partitions; a task streams through its slots and
holds one slot's current facts, never its history.

A fact whose restatement key is current is skipped. Otherwise its object is compared with those of current facts:
similarity >= HIGH: one token set inside the other extends, a multivalued predicate extends, else it supersedes; below
that an additive fact extends, else it supersedes. Superseding resets a functional slot, and closes only the nearest
fact of a multivalued one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH, LOW = 0.80, 0.45
_WORD = re.compile("[a-z0-9]+")
SCHEMA = "slot string, seq long, label string, route string, target long, similarity double, closed array<long>"


def same_object(a: str, b: str, va: object, vb: object) -> float:
    """The offline similarity: equal objects are alike, others not; with vectors, their cosine."""
    if va is None or vb is None:
        return float(a == b)
    x, y = np.asarray(va, float), np.asarray(vb, float)
    size = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float(x @ y) / size if size else 0.0


class Slot:
    """The current facts of one slot, by seq in the order of their coming: (key, object, vector).

    Keys and objects have indexes, so without vectors a fact costs the same however many are current.
    """

    def __init__(self, similarity: Callable = same_object, high: float = HIGH, low: float = LOW, judge: Callable[[str, str], str] | None = None):
        self.now: dict[int, tuple[str, str, object]] = {}
        self.keys: dict[str, int] = {}
        self.objects: dict[str, dict[int, None]] = {}
        self.vectors = 0
        self.similarity, self.high, self.low, self.model = similarity, high, low, judge

    def take(self, seq: int, key: str, obj: str, is_additive: bool, is_multivalued: bool, vector: object = None) -> tuple[str, str, int | None, float | None, list[int]]:
        """(label, route, target, similarity, closed) of a fact, which is current afterwards unless skipped."""
        if key and self.keys.get(key):
            return "skip", "restatement", None, None, []
        label, route, target, sim, closed = "asserts", "no_slot", None, None, []
        if self.now:
            target, sim = self.nearest(obj, vector)
            label, route = self.judge(sim, obj, self.now[target][1], is_additive, is_multivalued)
            if label == "supersedes":
                closed = [target] if is_multivalued else list(self.now)
                for s in closed:
                    self.drop(s)
        self.hold(seq, key, obj, vector)
        return label, route, target, sim, closed

    def nearest(self, obj: str, vector: object) -> tuple[int, float]:
        """The current fact most alike, the first of equals, and its similarity."""
        if self.similarity is same_object and (vector is None or not self.vectors):
            same = self.objects.get(obj)
            return (next(iter(same)), 1.0) if same else (next(iter(self.now)), 0.0)
        return max(((s, self.similarity(obj, f[1], vector, f[2])) for s, f in self.now.items()), key=lambda x: (x[1], -x[0]))

    def hold(self, seq: int, key: str, obj: str, vector: object) -> None:
        """Make a fact current."""
        self.now[seq] = (key, obj, vector)
        self.keys[key] = self.keys.get(key, 0) + 1
        self.objects.setdefault(obj, {})[seq] = None
        self.vectors += vector is not None

    def drop(self, seq: int) -> None:
        key, obj, vector = self.now.pop(seq)
        self.keys[key] -= 1
        del self.objects[obj][seq]
        if not self.objects[obj]:
            del self.objects[obj]
        self.vectors -= vector is not None

    def judge(self, sim: float, obj: str, old: str, is_additive: bool, is_multivalued: bool) -> tuple[str, str]:
        if sim >= self.high:
            a, b = set(_WORD.findall(obj.lower())), set(_WORD.findall(old.lower()))
            if a and b and (a < b or b < a):
                return "extends", "high_extends"
            return ("extends", "high_extends_additive") if is_multivalued else ("supersedes", "high_supersedes")
        if sim <= self.low:
            return ("extends", "low_extends") if is_additive else ("supersedes", "low_supersedes")
        if is_additive:
            return "extends", "mid_extends"
        if self.model is not None:
            label = self.model(obj, old)
            return (label if label in ("extends", "supersedes") else "supersedes"), "llm"
        return "supersedes", "ambiguous_default"


def fold(
    facts: DataFrame, slot: list[str], vector: str | None = None, high: float = HIGH, low: float = LOW, prior: DataFrame | None = None,
    judge: Callable[[str, str], str] | None = None,
) -> DataFrame:
    """Decisions for facts with columns seq, key, object, additive, multivalued: see SCHEMA.

    `judge`, a model, labels (new object, old object) between LOW and HIGH as extends or supersedes. `prior` holds facts that are current already, of the same columns; they come first and give no row.
    """
    columns = ["seq", "key", "object", "additive", "multivalued"]
    named = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in slot]).alias("slot")
    vec = F.col(vector).cast("array<double>") if vector else F.lit(None).cast("array<double>")
    rows = facts.select(named, *columns, vec.alias("vector"), F.lit(False).alias("seed"))
    if prior is not None:
        rows = rows.unionByName(prior.select(named, *columns, vec.alias("vector"), F.lit(True).alias("seed")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, Slot(same_object, high, low, judge)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["slot"] != name:
                    name, state = r["slot"], Slot(same_object, high, low, judge)
                if r["seed"]:
                    state.hold(r["seq"], r["key"], r["object"], r["vector"])
                else:
                    out.append((name, r["seq"], *state.take(r["seq"], r["key"], r["object"], r["additive"], r["multivalued"], r["vector"])))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            values = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.repartition("slot").sortWithinPartitions("slot", F.desc("seed"), "seq").mapInArrow(run, SCHEMA)


def escalation_rate(decisions: DataFrame) -> DataFrame:
    """The share of decisions on the route 'llm'."""
    return decisions.agg(F.coalesce(F.avg((F.col("route") == "llm").cast("double")), F.lit(0.0)).alias("rate"))

"""Embedders: a deterministic stand-in without a model, and the shape that real ones take."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int
    coarse: int

    def one(self, text: str) -> list[float]:
        """A query's vector, on the driver."""

    def column(self, text: Column) -> Column:
        """Vectors of a column, in Arrow batches on the executors."""


def pseudo_vector(text: str, dim: int) -> list[float]:
    """A unit vector drawn by a hash of the text: equal texts have equal vectors, others are nearly orthogonal."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / np.linalg.norm(v)).tolist()


class FakeEmbedder:
    def __init__(self, dim: int = 768, coarse: int = 256):
        self.dim, self.coarse = dim, coarse

    def one(self, text: str) -> list[float]:
        return pseudo_vector(text, self.dim)

    def column(self, text: Column) -> Column:
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def vectors(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else pseudo_vector(t, dim) for t in texts.to_pylist()], pa.list_(pa.float32()))

        return vectors(text)

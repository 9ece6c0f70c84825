"""Scores over columns: recency, standing value, the final score of a hit."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from factloom.schema import MS_PER_DAY

#: Decay a millisecond, weights, and the access count that saturates.
DECAY = 1.0 / (30 * MS_PER_DAY)
HIT_WEIGHTS = {"relevance": 0.6, "recency": 0.2, "importance": 0.2}
VALUE_WEIGHTS = {"salience": 0.5, "recency": 0.3, "access": 0.2}
ACCESS_FULL = math.log1p(10)


def anchor(last_access: Column, valid_at: Column) -> Column:
    """When a fact was last seen; a zero counts as never."""
    return F.coalesce(F.nullif(last_access, F.lit(0).cast("long")), valid_at)


def recency(last_access: Column, valid_at: Column, now: int | Column) -> Column:
    at = F.lit(now) if isinstance(now, int) else now
    return F.exp(-DECAY * F.greatest(F.lit(0), at - anchor(last_access, valid_at)))


def standing_value(salience: Column, last_access: Column, valid_at: Column, access_count: Column, now: int | Column) -> Column:
    w = VALUE_WEIGHTS
    return (
        w["salience"] * salience / 10.0
        + w["recency"] * recency(last_access, valid_at, now)
        + w["access"] * F.least(F.lit(1.0), F.log1p(access_count) / ACCESS_FULL)
    )


def minmax(score: Column, over: WindowSpec) -> Column:
    """Scaled to 0..1 over the window; 1 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((score - low) / (high - low))


def final_score(relevance: Column, recent: Column, salience: Column) -> Column:
    w = HIT_WEIGHTS
    return w["relevance"] * relevance + w["recency"] * recent + w["importance"] * salience / 10.0

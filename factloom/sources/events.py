"""The event log of adds and searches, and appended JSON lines for resumable stages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.inspect import activity, list_events, retained
from factloom.sources.store import Store


class EventLog:
    """Events are telemetry: recording never raises, and only the newest of a namespace count."""

    def __init__(self, store: Store, keep: int = 10_000):
        self.store, self.keep = store, keep

    def record(self, namespace: str, kind: str, ts: int, duration_ms: float, payload: dict) -> bool:
        try:
            row = [(uuid.uuid4().hex, namespace, ts, kind, float(duration_ms), json.dumps(payload, sort_keys=True))]
            self.store.append("event", self.store.spark.createDataFrame(row, "id string, namespace string, ts long, kind string, duration_ms double, payload string"))
        except Exception:  # a lost event must not fail what it tells of
            return False
        return True

    def events(self) -> DataFrame:
        return retained(self.store.read("event"), self.keep)

    def page(self, namespace: str, kind: str | None = None, page: int = 1, page_size: int = 50) -> DataFrame:
        return list_events(self.events(), namespace, kind, page, page_size)

    def activity(self, now: int, days: int = 7) -> DataFrame:
        return activity(self.events(), now, days)


def append_lines(rows: DataFrame, path: str) -> None:
    """Append a stage's results as JSON lines."""
    rows.write.mode("append").json(path)


def done(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Keys that a stage has results for already; none where it hasn't run."""
    try:
        return spark.read.schema(f"{key} string").json(path).select(key).where(F.col(key).isNotNull()).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{key} string")


def digest_matches(spark: SparkSession, path: str, sha256: str) -> bool:
    """Whether a dataset's file is the pinned one."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()["d"] == sha256

"""Structured Streaming: episodes as they come, exactly once by batch, and windowed activity with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.memory import Memory


def ingest(stream: DataFrame, memory: Memory, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Add a stream of episodes (namespace, raw, t_ref, source) batch by batch. A batch's mark is committed with its
    rows, so one that is replayed after a crash is skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        memory.add_batch(batch, mark=f"{_name(checkpoint)}-{batch_id:012d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _name(checkpoint: str) -> str:
    import hashlib

    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def activity(stream: DataFrame, ts: str = "ts", kind: str = "kind", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind in windows of event time; windows close when the watermark has passed them."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n")).select("window.start", kind, "n")

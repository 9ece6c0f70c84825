"""The spine's tables as append-only Parquet under one root, with one writer at a time.

Each append is one committed Parquet batch; readers see whole batches. Several appends of one unit of work are written
aside first; one file then commits them, and they are moved into place, by the next writer if this one is lost. Sequence
numbers are the batch's number in the high bits and a place inside it, so later batches come later.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schema
from factloom.operators.inspect import open_namespaces

TABLES: dict[str, T.StructType] = {
    "episode": schema.EPISODE, "entity": schema.ENTITY, "fact_assert": schema.FACT_ASSERT, "fact_event": schema.FACT_EVENT, "posting": schema.POSTING, "fact_derivation": schema.DERIVATION,
    "maintenance_run": schema.RUN, "maintenance_proposal": schema.PROPOSAL, "proposal_decision": schema.DECISION, "event": schema.EVENT,
}
#: Places of a batch.
BATCH = 1 << 32


class LeaseHeld(RuntimeError):
    """Another writer holds the store."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.root}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._unit: str | None = None
        self._owner = uuid.uuid4().hex

    def read(self, name: str) -> DataFrame:
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Append rows, inside a unit of work to what it will commit; columns that are missing are null, others are dropped."""
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        rows = rows.select(*columns)
        # a namespace's rows lie together in a file, and in the index a term's, so that reads of one pass over the others
        if order := [c for c in ("namespace", "term") if c in rows.columns]:
            rows = rows.sortWithinPartitions(*order)
        if self._unit is None:
            rows.write.mode("append").parquet(f"{self.root}/{name}")
        else:
            rows.write.mode("append").parquet(f"{self.root}/_units/{self._unit}/{name}")

    @contextmanager
    def unit(self, mark: str | None = None) -> Iterator[bool]:
        """A unit of work under the writer's lease: its appends are seen together or not at all, and leave nothing where
        it fails. With `mark`, a name for the work, it yields whether the mark is new, and commits it with the rows."""
        if self._unit is not None:
            raise RuntimeError("a unit of work holds no other")
        with self.lease():
            self.recover()
            if mark is not None and self._fs.exists(self._path(f"_marks/{mark}")):
                yield False
                return
            self._unit = uuid.uuid4().hex
            aside = self._path(f"_units/{self._unit}")
            try:
                self._fs.mkdirs(aside)
                if mark is not None:
                    self._fs.createNewFile(self._path(f"_units/{self._unit}/_mark-{mark}"))
                yield True
                self._fs.createNewFile(self._path(f"_units/{self._unit}/_COMMITTED"))
            except BaseException:
                self._fs.delete(aside, True)
                raise
            finally:
                self._unit = None
            self.recover()

    def recover(self) -> None:
        """Move what committed units hold into place, and remove the others. A file that is there already was moved before."""
        for name in TABLES:
            if self._fs.exists(self._path(f"_before/{name}")) and not self._fs.exists(self._path(name)):
                self._fs.rename(self._path(f"_before/{name}"), self._path(name))
        units = self._path("_units")
        for unit in self._fs.listStatus(units) if self._fs.exists(units) else []:
            folder = unit.getPath().toString()
            if self._fs.exists(self._path(f"_units/{unit.getPath().getName()}/_COMMITTED")):
                for entry in self._fs.listStatus(unit.getPath()):
                    name = entry.getPath().getName()
                    if name in TABLES:
                        self._fs.mkdirs(self._path(name))
                        for part in self._fs.listStatus(entry.getPath()):
                            if part.getPath().getName().startswith("part-"):
                                self._fs.rename(part.getPath(), self._path(f"{name}/{part.getPath().getName()}"))
                    elif name.startswith("_mark-"):
                        self._fs.mkdirs(self._path("_marks"))
                        self._fs.createNewFile(self._path(f"_marks/{name.removeprefix('_mark-')}"))
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)

    def next_batch(self) -> int:
        """Claim a batch number: numbers are files, and creating one is atomic."""
        self._fs.mkdirs(self._path("_batches"))
        n = len(self._fs.listStatus(self._path("_batches")))
        while not self._fs.createNewFile(self._path(f"_batches/{n:012d}")):
            n += 1
        return n

    @contextmanager
    def lease(self, name: str = "writer", stale_s: float = 3600.0) -> Iterator[None]:
        """Hold the writer's lease; taken or refused at once. One without a sign of life for `stale_s` is taken over.

        A lease holds its owner's token, so a writer that was taken over neither renews nor removes its successor's.
        """
        self._fs.mkdirs(self._path(""))
        path = self._path(f"_{name}.lease")
        if not self._claim(path):
            age = time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000
            if age <= stale_s:
                raise LeaseHeld(name)
            self._fs.delete(path, False)
            if not self._claim(path):
                raise LeaseHeld(name)
        try:
            yield
        finally:
            if self.holds(name):
                self._fs.delete(path, False)

    def _claim(self, path) -> bool:
        if not self._fs.createNewFile(path):
            return False
        out = self._fs.create(path, True)
        out.writeBytes(self._owner)
        out.close()
        return True

    def holds(self, name: str = "writer") -> bool:
        """Whether the lease is this writer's."""
        path = self._path(f"_{name}.lease")
        if not self._fs.exists(path):
            return False
        source = self._fs.open(path)
        try:
            return source.readLine() == self._owner
        finally:
            source.close()

    def heartbeat(self, name: str = "writer") -> None:
        """Renew the lease; a writer that was taken over stops here."""
        if not self.holds(name):
            raise LeaseHeld(f"{name}: taken over")
        self._fs.setTimes(self._path(f"_{name}.lease"), int(time.time() * 1000), -1)

    def clear(self, namespace: str) -> None:
        """Remove a namespace: every table is written again without it, then swapped in by two renames; a table that a
        lost writer left between the two is put back by the next one. Refused under a live lease."""
        with self.lease():
            self.recover()
            facts = self.read("fact_assert").where(F.col("namespace") != namespace).select("id")
            proposals = self.read("maintenance_proposal").where(F.col("namespace") != namespace).select("id")
            kept_by = {
                "fact_event": lambda t: t.join(facts.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi"),
                "fact_derivation": lambda t: t.join(facts.withColumnRenamed("id", "source_id"), "source_id", "left_semi"),
                "proposal_decision": lambda t: t.join(proposals.withColumnRenamed("id", "proposal_id"), "proposal_id", "left_semi"),
            }
            there = [n for n in TABLES if self._fs.exists(self._path(n))]
            for name in there:
                rows = self.read(name)
                rows = kept_by[name](rows) if name in kept_by else rows.where(F.col("namespace") != namespace)
                rows.select(*TABLES[name].names).write.mode("overwrite").parquet(f"{self.root}/_staged/{name}")
            self._fs.mkdirs(self._path("_before"))
            for name in there:
                self._fs.rename(self._path(name), self._path(f"_before/{name}"))
                self._fs.rename(self._path(f"_staged/{name}"), self._path(name))
            self._fs.delete(self._path("_before"), True)

    def namespaces(self) -> DataFrame:
        """Namespaces that have episodes, without reserved ones."""
        return open_namespaces(self.read("episode"))

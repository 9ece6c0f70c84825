"""What the operators of this subpackage share: sessions, shared folders, word-level token caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows an Arrow batch carries to a Python worker; documents are some kB each, so a batch stays near a few MB.
ARROW_ROWS = 500
#: Longest word that a worker keeps in its cache; longer ones are encoded anew each time.
LONGEST_KEPT = 48
#: Where the shared folder is a mounted one (file:), Hadoop without its native library starts a process `chmod` for each file,
#: and another for its checksum file. The raw file system writes no checksum files; pages carry their own, which reads verify.
RAW_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the memory of Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def release(*caches: dict | set) -> None:
    """Clear a worker's caches at a task's end, and give freed memory back: workers live on, with the next operator's."""
    for c in caches:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset on one machine (tests), a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder's URI under the shared folder; it is removed when the driver's Python ends, if the JVM still lives."""
    uri = f"{shared_folder(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    _own().append(uri)
    return uri


_made = threading.local()


def _own() -> list[str]:
    """Folders made by this thread, in order: a query runs in one."""
    if not hasattr(_made, "uris"):
        _made.uris = []
    return _made.uris


def made() -> int:
    return len(_own())


def drop(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Remove the folders made since a count of made(), but for the last ones: what a loop or a stage no longer needs."""
    uris = _own()
    gone = uris[since : len(uris) - keep]
    del uris[since : len(uris) - keep]
    for uri in gone:
        _remove(spark, uri)


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already; the shared folder then outlives it
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    uri = fresh_folder(spark, label)
    df.write.options(**RAW_FILES).parquet(uri)
    return spark.read.schema(df.schema).options(**VERIFIED).parquet(uri)


def broadcast_if_small(df: DataFrame, rows: int, bytes_per_row: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint only when the counted rows stay under the limit; beyond it Spark shuffles both sides."""
    return df.hint("broadcast") if rows * bytes_per_row <= limit else df


class WordCache:
    """Encodes texts word by word, each distinct word once per worker.

    `encode` maps words to the bytes of their ids. With `leading`, a word carries the space before it, and words are
    joined to the next where they are empty or end in white space: a token never spans the seam between a
    non-space character and a space. Without it, white space is dropped, and each word stands alone; lines are words' ends too.
    The cache is cleared when it reaches `limit` words.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], leading: bool, limit: int = 350_000):
        self.encode, self.leading, self.limit = encode, leading, limit
        self.kept: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}
        self.long: list[tuple[dict, str]] = []

    def _learn(self, words: Iterable[str], into: dict, prefix: str) -> None:
        words = list(words)
        if self.leading:
            seams = [w for w in words if not w or w[-1].isspace()]
            into.update(dict.fromkeys(seams))
            words = [w for w in words if w and not w[-1].isspace()]
        into.update(zip(words, self.encode([prefix + w for w in words]), strict=True))
        self.long += [(into, w) for w in words if len(w) > LONGEST_KEPT]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null as an empty one."""
        kept, first = self.kept, self.first
        if len(kept) > self.limit:
            kept.clear()
        if len(first) > 20_000:
            first.clear()
        prefix = " " if self.leading else ""
        split = [(t or "").split(" ") if self.leading else (t or "").replace("\n", " ").split(" ") for t in texts]
        heads = {p[0] for p in split}
        if self.leading:
            self._learn([h for h in heads if h not in first], first, "")
        self._learn(set().union(*split).difference(kept), kept, prefix)
        out = []
        for parts in split:
            if not self.leading:
                out.append(b"".join(map(kept.__getitem__, parts)))
                continue
            try:
                out.append(b"".join([first[parts[0]], *map(kept.__getitem__, parts[1:])]))
            except TypeError:  # a seam, kept as None
                out.append(self._seamed(parts))
        for store, w in self.long:
            store.pop(w, None)
        self.long.clear()
        return out

    def _seamed(self, parts: list[str]) -> bytes:
        """For texts with white space runs: words joined until one ends in a non-space character."""
        out, held = [], ""
        for i, p in enumerate(parts):
            held += p if i == 0 else " " + p
            if p and not p[-1].isspace():
                out.append(held)
                held = ""
        return b"".join(self.encode([*out, held] if held else out))


#: Marks that may follow a word; between a letter and one of them there is always a seam.
MARKS = ".,!?;:#*$%&|)]}\""

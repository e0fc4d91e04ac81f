"""Paths, scratch tables and file access that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local (tests)."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir", None) or getattr(spark, "_anamnesis_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="anamnesis-")
        spark._anamnesis_shared = at
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Scratch tables of this process that are still there.
held: set[str] = set()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    held.add(at)
    return at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    at = scratch(df.sparkSession, tag)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.scratch_path = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, getattr(table, "scratch_path", ""))


def remove(spark: SparkSession, at: str) -> None:
    if at in held:
        held.discard(at)
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, docs: DataFrame, made: set[str]) -> None:
    """Between the stages of a pipeline: deletes the scratch tables among `made` that docs, which has been written and read again, is not read
    from, and lets Spark's cleaner drop the shuffle files of what is finished."""
    files = docs.inputFiles() if made else []
    for at in [h for h in made if not any(h.rpartition("/")[2] in f for f in files)]:
        remove(spark, at)
        made.discard(at)
    settle(spark)


def settle(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects their plans; a driver with memory to spare would keep them for long."""
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes to be no column of df."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of at most `rows`, unless the session asks for other than Spark's 10,000: some are very long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path) of a URI, for tasks that stream bytes no Spark writer can lay out."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def blocks(text: str, size: int = 1 << 20, cut: str = " ") -> Iterator[str]:
    """The text in pieces of about `size`, each but the first starting at `cut`."""
    at, n = 0, len(text)
    while n - at > size:
        end = text.find(cut, at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Memory:
    """A cache of two generations: at `most` entries the young ones become the old, and what is asked for again moves back. Values aren't None."""

    held: weakref.WeakSet[Memory] = weakref.WeakSet()
    loaded: dict[str, dict] = {}

    def __init__(self, most: int, owner: str):
        self.most, self.owner, self.young, self.old = most, owner, {}, {}
        self.held.add(self)

    @classmethod
    def read(cls, owner: str) -> dict:
        """Where an operator keeps what it has read into this worker, such as a vocabulary."""
        return cls.loaded.setdefault(owner, {})

    @classmethod
    def only(cls, owner: str) -> None:
        """Drops the caches of other operators and what they have read, and gives their memory back: a Python worker lives on between stages."""
        others = [m for m in cls.held if m.owner != owner and (m.young or m.old)]
        for memory in others:
            memory.young, memory.old = {}, {}
        tables = [t for name, t in cls.loaded.items() if name != owner and t]
        for table in tables:
            table.clear()
        if not others and not tables:
            return
        pa.default_memory_pool().release_unused()
        if sys.platform.startswith("linux"):
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    def missing(self, keys: set) -> list:
        """The keys that must be worked out; all others are in `young` afterwards."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        out = []
        for key in keys.difference(self.young):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.young[key] = value
        return out

"""Helpers shared by the operators: inputs, the shared folder, written cuts."""

from __future__ import annotations

import itertools
import tempfile
import uuid
import weakref
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The words of a text everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary one; a cluster
    session without it is an error, as executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="regscope-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed
    once, cut from its lineage, and there for any executor that replaces a lost one."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._written_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete ``written`` tables. Nothing that is still to run may read them: what
    was made from them has been written itself."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(conf).delete(path, True)


class Cache(dict):
    """What a Python worker has worked out, by key, within ``limit`` bytes: when full, the older half goes.

    Workers are kept for later tasks, and so are their caches, for as long as the
    tasks are of one operator; ``alone`` empties those of the others."""

    ENTRY = 150  # bytes of a small entry, its key and value objects included
    _all: list[weakref.ref] = []

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        Cache._all.append(weakref.ref(self))

    def keep(self, key: Any, value: Any, size: int) -> Any:
        self[key] = value
        self.held += size + self.ENTRY
        if self.held > self.limit:
            for old in list(itertools.islice(self, len(self) // 2 + 1)):
                del self[old]
            self.held //= 2
        return value

    def empty(self) -> None:
        self.clear()
        self.held = 0

    def alone(self) -> "Cache":
        """Empty all others of this worker. Called when a task starts."""
        Cache._all[:] = [r for r in Cache._all if r() is not None]
        for r in Cache._all:
            other = r()
            if other is not None and other is not self and other:
                other.empty()
        pa.default_memory_pool().release_unused()
        return self


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python at most ``rows`` at a time: batches are held several times over, beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def broadcast_if_small(df: DataFrame, limit_mb: int = 16) -> DataFrame:
    """Hint a broadcast of a written table if its files are within ``limit_mb``.

    The size is what the planner knows of the files; beyond the limit the join
    shuffles, and adaptive execution splits its skewed partitions.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit_mb << 20 else df

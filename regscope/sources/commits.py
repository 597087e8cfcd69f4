"""Tables written in runs that a manifest publishes.

```
<path>/run=<number>-<id>/kind=<kind>/part-*      the rows of a run, by kind, in one write
<path>/_manifests/<number>.json                  the runs that count, and the cursor after them
```

A run writes its folder and is then published by creating the next manifest. The
cursor is in the same file as the names of the runs: after a crash between the two
steps the folder is named by no manifest, the cursor stands where it stood, and the
next run does the same rows again, so none is lost or there twice. Creating a
manifest that exists fails, so of two writers that saw the same state one raises and
publishes nothing. Nothing is renamed or listed but the manifests. A manifest that
a crash left incomplete is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Manifests:
    """Numbered manifest files of a folder, each created once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def _file(self, number: int):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, f"{number:08d}.json")

    def find(self, numbers) -> dict | None:
        """The first complete manifest among ``numbers``, with its number."""
        for number in numbers:
            stream = self._fs.open(self._file(number))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number}
            except ValueError:
                continue
            finally:
                stream.close()
        return None

    def create(self, number: int, data: dict) -> None:
        """Raises if the number is taken."""
        out = self._fs.create(self._file(number), False)
        out.write(bytearray(json.dumps(data).encode()))
        out.close()

    def delete(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)


def published(spark: SparkSession, target: str, write: Callable[[str], None]) -> str:
    """The folder below ``target`` that counts; ``write(folder)`` fills a new one if none does.

    Folders are never renamed: the first complete manifest names the one that counts. Writers
    take no lock. Of several at once the first to create a manifest wins, the others
    drop their folders and read the winner's; a writer that died left a folder nobody names."""
    manifests = Manifests(spark, target)
    state = manifests.find(manifests.numbers())
    if state is None:
        folder = f"try-{uuid.uuid4().hex}"
        write(f"{target}/{folder}")
        numbers = manifests.numbers()
        if manifests.find(numbers) is None:
            try:
                manifests.create(max([0, *numbers]) + 1, {"folder": folder})
            except Py4JJavaError:
                if manifests.numbers() == numbers:
                    raise
        # Another writer's manifest may be there but not complete yet: this folder is as good.
        state = manifests.find(manifests.numbers()) or {"folder": folder}
        if state["folder"] != folder:
            manifests.delete(f"{target}/{folder}")
    return f"{target}/{state['folder']}"


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = Manifests(spark, self.path)

    def state(self) -> dict:
        """number, cursor, runs and schema of the last complete manifest."""
        return self._manifests.find(reversed(self._manifests.numbers())) or {"number": 0, "cursor": None, "runs": [], "schema": None}

    def stage(self, rows: DataFrame) -> dict:
        """Write a run that doesn't count yet. ``rows`` may have the column ``kind``."""
        state, number = self.state(), max([0, *self._manifests.numbers()]) + 1
        if "kind" not in rows.columns:
            rows = rows.withColumn("kind", F.lit("row"))
        run = f"{number:08d}-{uuid.uuid4().hex}"
        rows.write.partitionBy("kind").parquet(f"{self.path}/run={run}")
        schema = T.StructType([f for f in rows.schema.fields if f.name != "kind"])
        return {"number": number, "runs": [*state["runs"], run], "schema": schema.jsonValue()}

    def publish(self, staged: dict, cursor=None) -> None:
        """Make a staged run count, with the cursor after it. Raises if its number is taken."""
        data = {k: staged[k] for k in ("runs", "schema")} | {"cursor": cursor}
        self._manifests.create(staged["number"], data)

    def append(self, rows: DataFrame, cursor=None) -> None:
        self.publish(self.stage(rows), cursor)

    def read(self, kind: str | None = None, last: bool = False) -> DataFrame:
        """The rows of all published runs, or of the ``last``, with ``run`` (its number) and ``kind``; only the
        kind's files are read."""
        state = self.state()
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType()
        full = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("kind", T.StringType())])
        if not state["runs"]:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.path}/run={r}" for r in (state["runs"][-1:] if last else state["runs"])]
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*paths)
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return rows.withColumn("run", F.substring("run", 1, 8).cast("long"))


def rows_since(table: CommittedTable, source: DataFrame, key: str) -> tuple[DataFrame, object]:
    """The rows beyond the table's cursor, and the cursor after them.

    The upper end is fixed first, so rows that arrive meanwhile wait for the next
    run. Rows without a key have no place in the order and are never taken."""
    low = table.state()["cursor"]
    fresh = source.where(F.col(key).isNotNull() if low is None else F.col(key) > F.lit(low))
    high = fresh.agg(F.max(key)).first()[0]
    return fresh.where(F.col(key) <= F.lit(high)), low if high is None else high


def ingest(table: CommittedTable, source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Do the rows since the last run and commit them with the new cursor."""
    rows, cursor = rows_since(table, source, key)
    table.append(work(rows), cursor)


def checked_rows(rows: DataFrame, error: Column, rules: dict[str, Column]) -> DataFrame:
    """``kind`` 'error' where ``error`` holds, 'reject' where a rule of the table fails,
    else 'good', and ``reason``: the first failed rule by name. Rows stay one row each."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    bad = F.coalesce(error, F.lit(False))
    return rows.withColumn("reason", F.when(bad, F.lit("decode")).otherwise(reason)).withColumn(
        "kind", F.when(bad, F.lit("error")).when(F.col("reason").isNotNull(), F.lit("reject")).otherwise(F.lit("good")))

"""Streaming twin of the batch pipeline.

A micro-batch writes its output, and the state after it, as one run of a ``CommittedTable``; the
manifest that publishes the run holds the batch's number. A batch that is replayed after a crash
finds its number published and does nothing, or finds it missing and does its work again,
so rows are neither lost nor there twice. No stream keeps operator state.

* ``scan_batches`` (T1): rows of a streaming plan as they come.
* ``context_batch`` (T2): the author context. The state is the last two events of each
  author. A batch and the state go through the batch operator W1, whose ranges split an author's
  rows, so a hot author is never one group. A row older than its author's last event (late) is
  scored against the state and does not rewind it. On in-order input the result equals W1 (tested).
* ``new_ids_batch`` (T3): one row per id over all batches. The ids of the committed rows are the
  index; those of the batch are looked up in it by a semi-join.

Checkpoints and tables live under the shared checkpoint directory, so a restarted query
resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.context import author_context, blend
from ..session import cut_lineage, shared_path
from ..sources.commits import CommittedTable

NO_TIME = -(1 << 62)


def land(df: DataFrame, dest: str, files: int = 4) -> str:
    """One delivery: ``df`` as ``files`` new files of the landing folder, in one write."""
    df.repartition(files).write.mode("append").parquet(dest)
    return dest


def run_batches(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Pass everything that has arrived through ``each``, batch by batch, and stop."""
    q = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_table(spark: SparkSession, run_id: str) -> tuple[CommittedTable, str]:
    """The committed table of a stream and its checkpoint folder."""
    return CommittedTable(spark, shared_path(spark, "streams", run_id, "table")), shared_path(spark, "streams", run_id, "checkpoint")


def _done(table: CommittedTable, batch_id: int) -> bool:
    cursor = table.state()["cursor"]
    return cursor is not None and cursor >= batch_id


def scan_batches(table: CommittedTable) -> Callable[[DataFrame, int], None]:
    """Every batch is committed once."""
    def each(batch: DataFrame, batch_id: int) -> None:
        if not _done(table, batch_id):
            table.append(batch, batch_id)
    return each


def new_ids_batch(table: CommittedTable, id_col: str) -> Callable[[DataFrame, int], None]:
    """Commit the rows whose id no earlier batch committed, one per id (which of a batch's
    rows of one id is not defined). Rows without an id can't be told apart and all stay.

    The index is the id column of the committed rows. A small batch is broadcast to it by
    its bytes, so the index isn't shuffled; nothing else grows with the stream's age."""
    def each(batch: DataFrame, batch_id: int) -> None:
        if _done(table, batch_id):
            return
        rows = cut_lineage(batch)
        fresh = rows.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        if table.state()["runs"]:
            seen = table.read("row").select(id_col).join(rows.select(id_col), id_col, "left_semi")
            fresh = fresh.join(seen, id_col, "left_anti")
        table.append(fresh.unionByName(rows.where(F.col(id_col).isNull())), batch_id)
    return each


def context_batch(table: CommittedTable, key: str, id_col: str, ts_col: str, feat: str) -> Callable[[DataFrame, int], None]:
    """Commit ``(id, key, ctx)`` of the batch's rows, and the state after them, as kinds
    'row' and 'state'. ``feat`` is an array<double>. Rows without a time come first among their
    author's, as in W1; rows without an author get their own features and leave no state."""
    order = ["_ts", id_col]

    def each(batch: DataFrame, batch_id: int) -> None:
        if _done(table, batch_id):
            return
        ts = F.coalesce(F.unix_micros(F.col(ts_col).cast("timestamp")), F.lit(NO_TIME))
        rows = cut_lineage(batch.select(id_col, key, ts.alias("_ts"), F.col(feat).alias("_f")))
        before = table.read("state", last=True) if table.state()["runs"] else rows.limit(0)
        before = before.select(id_col, key, "_ts", "_f")

        # Two events per author at most.
        last = before.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "_f")), asc=False).alias("_last"))
        late = F.coalesce(F.struct(*order) < F.struct(*[F.col("_last")[0][c].alias(c) for c in order]), F.lit(False))
        met = rows.join(last, key, "left").withColumn("_late", late)
        # Late rows see the state as it is; ``get`` is null where it has one event.
        behind = met.where("_late").select(id_col, key, blend(F.col("_f"), F.get("_last", F.lit(0))["_f"], F.get("_last", F.lit(1))["_f"]).alias("ctx"))
        line = met.where("not _late").select(id_col, key, *order[:1], "_f", F.lit(True).alias("_new")).unionByName(
            before.withColumn("_new", F.lit(False)))
        line = cut_lineage(line)
        ahead = author_context(line, key, [*order, "_new"], "_f", id_col=id_col).where("_new").select(id_col, key, "ctx")

        newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in [*order, "_new"]])
        keep = (line.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
                .withColumn("_r", F.row_number().over(newest)).where("_r <= 2").select(id_col, key, "_ts", "_f"))
        out = behind.unionByName(ahead).withColumn("kind", F.lit("row"))
        table.append(out.unionByName(keep.withColumn("kind", F.lit("state")), allowMissingColumns=True), batch_id)
    return each

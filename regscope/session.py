"""Spark session and shared-storage helpers.

The library never picks a machine-local folder on a cluster: lineage is cut
with ``checkpoint()`` into the directory the cluster names in
``spark.checkpoint.dir``. Only when that setting is absent (local tests) do we
create one under the system temp folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Session settings the pipelines rely on: AQE re-plans joins and
# coalesces partitions at run time, UTC keeps event ordering stable, ANSI makes
# dirty input fail loudly unless a try_* function is used on purpose.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Archive rows are large: keep Arrow batches small for the archive readers.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "regscope", cpus: str | int | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above.

    ``cpus`` asks for a local session (tests, the bench). Without it neither
    master nor memory nor a number of shuffle partitions is set: on a cluster
    they come from ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app)
    conf = dict(BASE_CONF)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
        conf |= {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"}
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**conf, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``, the same one in every session.

    A local session without it gets a temporary folder; on a cluster that is an
    error, as executors could not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="regscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared folder (for state, streams, models)."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), *parts])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Hand Python at most ``rows`` rows at a time in a session that ``get_spark`` didn't build: a batch
    of archives or texts is held several times over in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def drop_lineage(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` wrote in this application; call it before stopping."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "lineage", spark.sparkContext.applicationId))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a parquet table written under the shared checkpoint
    directory and read back. Survives executor loss like a reliable
    checkpoint, but computes the input once (an RDD checkpoint without a
    persist runs it twice) and the result is columnar, so later reads prune
    columns."""
    import uuid
    path = shared_path(df.sparkSession, "lineage", df.sparkSession.sparkContext.applicationId, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

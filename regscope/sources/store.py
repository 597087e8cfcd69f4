"""Normalised tables written once into shared storage.

A table is keyed by its name, the input directory and the size and
modification time of each input's part files and a plan version, so a changed
input or definition gives a new table.
A manifest names the folder that counts (``commits.published``), so a failed or
concurrent build never shows a half-written table, and nothing is renamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path
from .commits import published


# Raise it when a stored table's definition changes.
PLAN_VERSION = 5


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def fingerprint(spark: SparkSession, sf_dir: str, inputs: list[str]) -> str:
    """A key of the inputs' part files and the plan version."""
    h = hashlib.sha1(f"{PLAN_VERSION}:{sf_dir}".encode())
    for name in inputs:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        fs, p, _ = _fs(spark, path)
        # A table may be a folder: every part file counts, not the folder's own time.
        parts = [st for st in fs.listStatus(p) if not st.getPath().getName().startswith(("_", "."))]
        for line in sorted(f"{name}:{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}" for st in parts):
            h.update(line.encode())
    return h.hexdigest()[:16]


def materialized(spark: SparkSession, name: str, sf_dir: str, inputs: list[str],
                 build: Callable[[], DataFrame]) -> DataFrame:
    target = shared_path(spark, "tables", f"{name}-{fingerprint(spark, sf_dir, inputs)}")
    return spark.read.parquet(published(spark, target, lambda folder: build().write.parquet(folder)))

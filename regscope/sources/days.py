"""A table partitioned by release day (S9): ``<path>/release_day=2024-02-29/part-*``.

The days that exist, and how many rows each has, come from the layout and the file
footers: no column is read. A range of days reads only its folders. Rows without a
time are in a partition of their own. A day is as many files as its rows fill, from
whichever tasks hold them, so a large day is not gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "release_day"
ROWS_A_FILE = 1_000_000


def write_days(rows: DataFrame, time_col: str, path: str) -> None:
    (rows.withColumn(DAY, F.to_date(time_col)).write.option("maxRecordsPerFile", ROWS_A_FILE)
     .partitionBy(DAY).parquet(path))


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows released from ``first`` to ``last`` (both included; all rows without them)."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(DAY) >= F.lit(first).cast("date")) if first else rows
    return rows.where(F.col(DAY) <= F.lit(last).cast("date")) if last else rows


def listed_days(table: DataFrame) -> DataFrame:
    """release_day and n, the rows of each day's files."""
    return table.groupBy(DAY).agg(F.count(F.lit(1)).alias("n"))


def calendar(listed: DataFrame) -> DataFrame:
    """Every day of each month that has releases, with n (0 on days without a folder)."""
    months = listed.where(F.col(DAY).isNotNull()).select(F.trunc(DAY, "month").alias("m")).distinct()
    days = months.select(F.explode(F.sequence("m", F.last_day("m"))).alias(DAY))
    return days.join(listed, DAY, "left").select(DAY, F.coalesce("n", F.lit(0)).alias("n"))

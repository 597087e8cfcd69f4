"""The table partitioned by release day."""

from pyspark.sql import functions as F

from regscope.sources import days as D


def test_only_the_wanted_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(400).select("id", F.when(F.col("id") % 50 != 0, F.timestamp_seconds(1709078400 + F.col("id") * 1800)).alias("ts"))
    D.write_days(rows, "ts", path)
    two = D.read_days(spark, path, "2024-02-29", "2024-03-01")
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(release_day" in plan and "PushedFilters: []" in plan
    read = {r.f.split("release_day=")[1].split("/")[0] for r in two.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read == {"2024-02-29", "2024-03-01"}
    want = rows.where(F.to_date("ts").between("2024-02-29", "2024-03-01")).count()
    assert two.count() == want


def test_days_are_counted_without_reading_columns(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(1, "2024-02-28 01:00:00"), (2, "2024-02-28 23:59:59"), (3, None), (4, "2024-04-30 00:00:00")], "id long, t string")
    D.write_days(rows.select("id", F.to_timestamp("t").alias("ts")), "ts", path)
    listed = D.listed_days(D.read_days(spark, path))
    assert "ReadSchema: struct<>" in listed._jdf.queryExecution().executedPlan().toString()
    assert {(str(r.release_day), r.n) for r in listed.collect()} == {("2024-02-28", 2), ("None", 1), ("2024-04-30", 1)}
    days = {str(r.release_day): r.n for r in D.calendar(listed).collect()}
    assert len(days) == 29 + 30 and days["2024-02-28"] == 2 and days["2024-02-29"] == 0 and "2024-03-01" not in days

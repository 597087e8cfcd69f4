"""Runs published by manifests, cursors, rejects and guarded decoding."""

import pytest
from pyspark.sql import functions as F

from regscope.sources import archives as AR
from regscope.sources.commits import CommittedTable, checked_rows, ingest, rows_since


def ids(table):
    return sorted((r.id, r.run) for r in table.read().collect())


def test_crash_between_write_and_commit_repeats_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    assert table.read().collect() == [] and table.state()["cursor"] is None
    source = spark.range(10).toDF("id")
    ingest(table, source, "id", lambda r: r)
    assert table.state()["cursor"] == 9
    rows, cursor = rows_since(table, spark.range(15).toDF("id"), "id")
    table.stage(rows)                                   # the process ends here
    assert (len(ids(table)), table.state()["cursor"]) == (10, 9)
    ingest(table, spark.range(20).toDF("id"), "id", lambda r: r)
    assert ids(table) == [(i, 1) for i in range(10)] + [(i, 2) for i in range(10, 20)]
    ingest(table, spark.range(20).toDF("id"), "id", lambda r: r)   # nothing new
    assert len(ids(table)) == 20 and table.state()["cursor"] == 19


def test_torn_manifest_is_passed_over(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    ingest(table, spark.range(5).toDF("id"), "id", lambda r: r)
    (tmp_path / "t" / "_manifests" / "00000002.json").write_text('{"runs": ["0000')
    assert len(ids(table)) == 5
    ingest(table, spark.range(8).toDF("id"), "id", lambda r: r)
    assert ids(table) == [(i, 1) for i in range(5)] + [(i, 3) for i in range(5, 8)]


def test_second_writer_of_a_number_publishes_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    a, b = table.stage(spark.range(3).toDF("id")), table.stage(spark.range(3, 6).toDF("id"))
    table.publish(a, 2)
    with pytest.raises(Exception, match="exists"):
        table.publish(b, 5)
    assert [i for i, _ in ids(table)] == [0, 1, 2] and table.state()["cursor"] == 2


def test_kinds_are_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", False), (2, None, False), (3, "c", True), (4, "", False), (None, None, None)], "id long, name string, bad boolean")
    table = CommittedTable(spark, str(tmp_path / "t"))
    table.append(checked_rows(rows, F.col("bad"), {"id": F.col("id").isNotNull(), "name": F.col("name") != ""}))
    kinds = {(r.id, r.kind, r.reason) for r in table.read().collect()}
    assert kinds == {(1, "good", None), (2, "reject", "name"), (3, "error", "decode"), (4, "reject", "name"), (None, "reject", "id")}
    good = table.read("good")
    assert "PartitionFilters: [isnotnull(kind" in good._jdf.queryExecution().toString() and [r.id for r in good.collect()] == [1]


def test_decode_never_ends_the_job(spark):
    cases = [b"plain", "é€".encode(), "é𝄞x".encode("utf-16"), "é𝄞".encode("utf-16-be"), b"\xd8\x00", b"\xd8\x00ab", b"\xdc\x00\xd8\x00", b"\xff",
             b"\xff\xfe\x00\xd8\x00\xdc", b"\xff\xfe\x00\xdc\x00\xd8", b"", None, b"\xfe\xff"]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    got = {r.i: r.text for r in rows.select("i", *AR.decode_utf8_or(F.col("c"), "UTF-16")).collect()}
    for i, c in enumerate(cases):
        want = None
        for name in ("utf-8", "utf-16" if c and c[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-16-be"):
            try:
                want = None if c is None else c.decode(name)
                break
            except UnicodeDecodeError:
                continue
        assert got[i] == want, (c, got[i], want)

"""Archive readers on real files in a fresh folder; streaming state equals the
batch window; idempotent sink."""

import io
import json
import os
import tarfile
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from regscope.operators import context as CTX
from regscope.sources import archives as AR
from regscope.sources import fixtures as FX
from regscope.sources.commits import CommittedTable
from regscope.streaming import author_state as ST

from conftest import SF_SMALL


def _tgz(files):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        for n, data in files:
            info = tarfile.TarInfo(n)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def test_archive_readers(spark):
    d = tempfile.mkdtemp(prefix="regscope-arch-")
    man = json.dumps({"name": "p1", "description": "d", "homepage": "https://www.example.com/x",
                      "repository": {"url": "git+https://github.com/u/p"}}).encode()
    open(os.path.join(d, "a.tgz"), "wb").write(_tgz([("package/package.json", man),
                                                     ("package/readme.md", "caf\xe9 [x](http://a.b)".encode("latin-1")),
                                                     ("package/README.MD", b"second")]))
    open(os.path.join(d, "b.tgz"), "wb").write(_tgz([("package/index.js", b"x")]))  # no manifest
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.nuspec", "<authors>é</authors>".encode("utf-16"))
        z.writestr(zipfile.ZipInfo("lib/"), b"")
        z.writestr("README.md", b"hello")
    open(os.path.join(d, "c.nupkg"), "wb").write(buf.getvalue())
    open(os.path.join(d, "d.nupkg"), "wb").write(b"PK\x03\x04 broken")
    files = spark.read.format("binaryFile").load(d)
    m = AR.archive_members(files).cache()
    rows = {(os.path.basename(r.path), r.member): r for r in m.collect()}
    assert rows[("a.tgz", "package/readme.md")].n_members == 3
    assert rows[("b.tgz", None)].n_members == 1
    assert rows[("c.nupkg", "x.nuspec")].n_dirs == 1
    assert rows[("d.nupkg", None)].error is not None
    pk = {os.path.basename(r.path): r for r in AR.npm_packages(m).collect()}
    a = pk["a.tgz"]
    # first README spelling present wins; Latin-1 fallback recorded
    assert a.readme == "caf\xe9 [x](http://a.b)" and a.readme_latin and a.homepage_domain == "example.com"
    assert pk["b.tgz"].name == "" and pk["b.tgz"].readme == ""
    nus = m.where(F.col("member") == "x.nuspec").select(*AR.decode_utf8_or(F.col("content"), "UTF-16")).first()
    assert nus.text == "<authors>é</authors>" and nus.used_fallback


def _events(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, user_id string, t long, value double")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("f", F.array("value")).drop("t", "value")


def _context(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "ctx"))
    return table, ST.context_batch(table, "user_id", "event_id", "ts", "f")


def _plain_context(rows):
    """The context of every row by walking each user's events in order."""
    state, out = {}, {}
    for i, user, t, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        last = state.get(user, [])
        out[i] = v if not last or not user else last[-1] if len(last) == 1 else 0.6 * last[-1] + 0.4 * last[-2]
        state[user] = [*last[-1:], v]
    return out


def test_stream_state_equals_window(spark, tmp_path):
    rows = [(i, str(i % 7) if i % 11 else ["", None][i % 2], 1_700_000_000 + i * 3000 if i > 20 else None, float(i)) for i in range(300)]
    df = _events(spark, rows)
    table, each = _context(spark, tmp_path)
    landing = str(tmp_path / "land")
    for lo, hi in ((0, 130), (130, 131), (131, 300)):
        ST.land(df.where(f"event_id >= {lo} and event_id < {hi}"), landing, 2)
        ST.run_batches(spark.readStream.schema(df.schema).parquet(landing), each, str(tmp_path / "checkpoint"))
    got = {r.event_id: r.ctx[0] for r in table.read("row").collect()}
    want = _plain_context(rows)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    batch = {r.event_id: r.ctx[0] for r in CTX.author_context(df, "user_id", ["ts", "event_id"], "f", id_col="event_id").collect()}
    assert all(abs(got[i] - batch[i]) < 1e-9 for i in want)
    # Two events per author are kept, none for rows without one.
    assert sorted(r["count"] for r in table.read("state", last=True).groupBy("user_id").count().collect()) == [2] * 7


def test_late_row_does_not_rewind_and_replay_does_nothing(spark, tmp_path):
    table, each = _context(spark, tmp_path)
    each(_events(spark, [(1, "a", 10, 1.0), (2, "a", 20, 2.0), (3, "a", 30, 4.0), (4, "b", 5, 7.0), (5, None, 5, 9.0)]), 0)
    got = lambda: {r.event_id: r.ctx[0] for r in table.read("row").collect()}
    assert got() == {1: 1.0, 2: 1.0, 3: 0.6 * 2 + 0.4 * 1, 4: 7.0, 5: 9.0}
    # A late row is scored against the state; rows after the last event go on from it.
    second = _events(spark, [(9, "a", 15, 100.0), (10, "a", 40, 8.0), (11, "a", 50, 0.0), (12, "b", 1, 3.0)])
    rows = table.stage                                        # the process ends before the manifest
    table.stage = lambda r: (rows(r), 1 / 0)
    with pytest.raises(ZeroDivisionError):
        each(second, 1)
    table.stage = rows
    each(second, 1)
    each(second, 1)
    out = got()
    assert len(out) == table.read("row").count() == 9
    assert abs(out[9] - (0.6 * 4 + 0.4 * 2)) < 1e-9 and abs(out[10] - (0.6 * 4 + 0.4 * 2)) < 1e-9
    assert abs(out[11] - (0.6 * 8 + 0.4 * 4)) < 1e-9 and out[12] == 7.0
    assert {(r.event_id, r.user_id) for r in table.read("state", last=True).collect()} == {(11, "a"), (10, "a"), (4, "b")}


def test_hot_author_in_a_stream_is_split(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.lit("hot").alias("user_id"),
                               F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.array(F.col("id") % 97 * 1.0).alias("f"))
    table, each = _context(spark, tmp_path)
    each(df.where("event_id < 120000"), 0)
    each(df.where("event_id >= 120000"), 1)
    want = F.when(F.col("event_id") == 0, 0.0).when(F.col("event_id") == 1, 0.0).otherwise(
        0.6 * ((F.col("event_id") - 1) % 97) + 0.4 * ((F.col("event_id") - 2) % 97))
    rows = table.read("row")
    assert rows.count() == n and rows.where(F.abs(F.col("ctx")[0] - want) > 1e-9).count() == 0


def test_once_per_id_over_batches(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"))
    each = ST.new_ids_batch(table, "id")
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    each(rows([1, 2, 2, None, None]), 0)
    each(rows([2, 3]), 1)
    each(rows([2, 3]), 1)                                     # replayed
    each(rows([]), 2)
    each(rows([1, 2, 3, 4, None]), 3)
    assert sorted(r.id or 0 for r in table.read("row").collect()) == [0, 0, 0, 1, 2, 3, 4]
    assert table.state()["cursor"] == 3


def test_archives_reach_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        FX.npm_archive_files(spark, SF_SMALL)
        assert int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, before)

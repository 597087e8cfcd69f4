"""Author context: hand-worked decay and plain/chunked equivalence."""

import random

from pyspark.sql import functions as F

from regscope.operators import context as CTX


def _rows(n_hot=400, n_small=60, seed=7):
    rnd = random.Random(seed)
    rows = []
    pid = 0
    for author, n in [("hot", n_hot), ("a", n_small), ("b", n_small), (None, 20), ("", 5)]:
        t = 0
        for _ in range(n):
            t += rnd.randint(0, 20000)
            rows.append((pid, author, t, [rnd.random(), float(pid)]))
            pid += 1
    return rows


def _df(spark, rows):
    df = spark.createDataFrame(rows, "package_id long, author string, t long, f array<double>")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def test_three_packages(spark):
    df = _df(spark, [(1, "x", 10, [1.0]), (2, "x", 20, [2.0]), (3, "x", 30, [4.0]), (4, "x", 40, [8.0])])
    out = {r.package_id: r.ctx[0] for r in CTX.author_context(df, "author", ["ts", "package_id"], "f").collect()}
    assert out[1] == 1.0 and out[2] == 1.0
    assert abs(out[3] - (0.6 * 2 + 0.4 * 1)) < 1e-12 and abs(out[4] - (0.6 * 4 + 0.4 * 2)) < 1e-12


def test_no_author_uses_own(spark):
    df = _df(spark, [(1, None, 10, [1.0]), (2, None, 20, [2.0]), (3, "", 30, [3.0])])
    out = {r.package_id: r.ctx[0] for r in CTX.author_context(df, "author", ["ts", "package_id"], "f").collect()}
    assert out == {1: 1.0, 2: 2.0, 3: 3.0}


def _plain(df, order):
    """Lag over the whole author, as one window."""
    from pyspark.sql import Window
    no_author = F.col("author").isNull() | (F.col("author") == "")
    key = F.when(no_author, F.concat(F.lit("none:"), F.col("package_id").cast("string"))).otherwise(F.col("author"))
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    f = F.col("f")
    return {r.package_id: r.ctx for r in df.select("package_id", CTX.blend(f, F.lag(f, 1).over(w), F.lag(f, 2).over(w)).alias("ctx")).collect()}


def test_chunks_do_not_change_the_context(spark):
    order = ["ts", "package_id"]
    df = _df(spark, _rows())
    late = df.withColumn("ts", F.when(F.col("package_id").cast("string").rlike("[37]$"), None).otherwise(F.col("ts")))
    one_day = df.withColumn("ts", F.min("ts").over(__import__("pyspark").sql.Window.partitionBy()))
    for frame in (df, late, one_day):
        want = _plain(frame, order)
        for chunks in (1, 7, 150):  # the hot author spans many chunks, some hold a row
            got = {r.package_id: r.ctx for r in CTX.author_context(frame, "author", order, "f", chunks=chunks).collect()}
            assert got == want


def test_nulls_before_a_day(spark):
    """Three packages without a time, two on day A, one on the next day."""
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    rows = [(1, None), (2, None), (3, None), (4, day), (5, day + dt.timedelta(hours=1)), (6, day + dt.timedelta(days=1))]
    df = spark.createDataFrame([(i, "a", t, [float(i)]) for i, t in rows], "package_id long, author string, ts timestamp, f array<double>")
    got = {r.package_id: round(r.ctx[0], 6) for r in CTX.author_context(df, "author", ["ts", "package_id"], "f", chunks=6).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.6, 4: 2.6, 5: 3.6, 6: 4.6}

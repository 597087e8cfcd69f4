"""Metrics, split, min-max guard and the forest on separable data."""

import random

from pyspark.sql import functions as F

from regscope.operators import links as L
from regscope.operators import model as M
from regscope.sources import commits as CO
from regscope.sources import models as MO


def test_weighted_metrics_hand_worked(spark):
    rows = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("b", "a")] * 2
    df = spark.createDataFrame(rows, "label string, pred string")
    r = M.weighted_metrics(df).first()
    # class a: tp 3, support 4, predicted 5; class b: tp 2, support 4, predicted 3
    pa, ra, pb, rb = 3 / 5, 3 / 4, 2 / 3, 2 / 4
    f = lambda p, q: 2 * p * q / (p + q)
    assert abs(r.accuracy - 5 / 8) < 1e-12
    assert abs(r.precision - (pa + pb) / 2) < 1e-12
    assert abs(r.recall - (ra + rb) / 2) < 1e-12
    assert abs(r.f1 - (f(pa, ra) + f(pb, rb)) / 2) < 1e-12


def test_minmax_guard(spark):
    rows = [(1, 0, 1.0), (2, 0, 3.0), (1, 1, 5.0), (2, 1, 5.0)]
    df = spark.createDataFrame(rows, "r long, i long, value double")
    assert sorted(r.value for r in M.minmax_long(df).collect()) == [1.0, 3.0, 5.0, 5.0]  # column 1 constant
    rows2 = [(1, 0, 1.0), (2, 0, 3.0), (1, 1, 5.0), (2, 1, 7.0)]
    out = M.minmax_long(spark.createDataFrame(rows2, "r long, i long, value double"))
    assert sorted(r.value for r in out.collect()) == [0.0, 0.0, 1.0, 1.0]


def test_split_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    share = M.split_rows(df, "k", 0.3).where(F.col("split") == "test").count() / 20000
    assert abs(share - 0.3) < 0.02


def test_forest_beats_majority(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        y = "abuse" if i % 3 == 0 else "non-abuse"
        base = 0.8 if y == "abuse" else 0.2
        rows.append((i, y, [base + rnd.uniform(-0.15, 0.15), rnd.random(), rnd.random()]))
    df = M.split_rows(spark.createDataFrame(rows, "package_id long, label string, features array<double>"),
                      "package_id", 0.3)
    model = M.fit_forest(df.where("split = 'train'"), num_trees=20, max_depth=5)
    r = M.weighted_metrics(M.score(model, df.where("split = 'test'"))).first()
    assert r.accuracy > 0.9


def test_labelled_by_name_first_match(spark):
    pk = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "package_id long, name string")
    lab = spark.createDataFrame([("a", "abuse"), ("c", "non-abuse")], "name string, label string")
    rows = M.labelled_by_name(pk, lab).collect()
    assert [(r.package_id, r.name, r.label) for r in rows] == [(1, "a", "abuse")]


def _points(spark, n=200):
    rows = [(i, "abuse" if i % 3 == 0 else "non-abuse", [float(i % 3), float(i % 7)]) for i in range(n)]
    return spark.createDataFrame(rows, "package_id long, label string, features array<double>")


def test_one_fit_per_snapshot_and_settings(spark, monkeypatch, tmp_path):
    fits, plans = [], []
    monkeypatch.setattr(MO, "shared_path", lambda s, *p: "/".join([str(tmp_path), *p]))
    real = M.fit_forest
    monkeypatch.setattr(MO.M, "fit_forest", lambda *a, **k: fits.append(1) or real(*a, **k))
    rows = lambda: plans.append(1) or _points(spark)
    small = MO.ForestSettings(num_trees=5, max_depth=3)
    first = MO.stored_forest(spark, "image", "k1", small, rows)
    again = MO.stored_forest(spark, "image", "k1", small, rows)
    assert first.path == again.path and (len(fits), len(plans)) == (1, 1)
    # A scoring job of another session loads the same model.
    other = MO.stored_forest(spark.newSession(), "image", "k1", small, rows)
    got = {r.package_id: r.pred for r in M.score(other.model(), _points(other.spark)).collect()}
    assert len(fits) == 1 and got == {i: "abuse" if i % 3 == 0 else "non-abuse" for i in range(200)}
    # The kept matrices are the two sides of the split.
    assert first.rows("train").count() + first.rows("test").count() == 200
    assert "PartitionFilters: [isnotnull(split" in first.rows("test")._jdf.queryExecution().toString()
    MO.stored_forest(spark, "image", "k2", small, rows)
    MO.stored_forest(spark, "image", "k1", MO.ForestSettings(num_trees=6, max_depth=3), rows)
    assert len(fits) == 3


def test_fit_holds_bounded_statistics(spark):
    train = _points(spark)
    model = M.fit_forest(train, num_trees=3, max_depth=2)
    # A task of the fit holds this much; two tasks of an executor with 1.8 GB must have room for it.
    assert 2 * model.stages[1].getMaxMemoryInMB() <= 1800 // 3


def test_forest_is_stored_and_scored_in_parts(spark, monkeypatch, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "abuse" if rnd.random() < 0.3 else "non-abuse", [rnd.random() for _ in range(5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "package_id long, label string, features array<double>")
    model = M.fit_forest(df.where("package_id < 400"), num_trees=5, max_depth=6)
    rf = model.stages[1]
    plain = {r.package_id: r.pred for r in M.score(model, df).collect()}
    assert len(set(plain.values())) == 2
    trees = [t.numNodes for t in rf.trees]
    for nodes, parts in ((10 ** 6, 1), (sum(trees) // 2, None), (1, 5)):
        monkeypatch.setattr(M, "PART_NODES", nodes)
        M.save_forest(model, spark, f"{tmp_path}/{nodes}")
        forest = M.load_forest(spark, f"{tmp_path}/{nodes}")
        held = [[t.numNodes for t in p.stages[1].trees] for p in forest.load()]
        # All trees in their order, and no part above the bound unless it is one tree.
        assert sum(held, []) == trees and all(sum(p) <= nodes or len(p) == 1 for p in held)
        assert parts in (None, len(held)) and (parts or len(held) > 1)
        got = M.score(forest, df.drop("label"))
        assert {r.package_id: r.pred for r in got.collect()} == plain and got.columns == ["package_id", "features", "pred"]
        assert [v for _, _, v in M.importances(forest, ["a"])] == rf.featureImportances.toArray().tolist()


def test_published_folder_survives_crash_and_race(spark, tmp_path):
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    target = str(tmp_path / "t")

    def dies(folder):
        write(3)(folder)
        raise RuntimeError("lost")

    try:
        CO.published(spark, target, dies)
    except RuntimeError:
        pass
    assert spark.read.parquet(CO.published(spark, target, write(5))).count() == 5
    assert spark.read.parquet(CO.published(spark, target, write(9))).count() == 5
    # Another writer publishes while this one writes: its folder counts, ours goes.
    target, won = str(tmp_path / "u"), []

    def slow(folder):
        write(7)(folder)
        won.append((folder, CO.published(spark, target, write(2))))

    got = CO.published(spark, target, slow)
    assert got == won[0][1] != won[0][0] and spark.read.parquet(got).count() == 2
    assert not (tmp_path / "u" / won[0][0].rsplit("/", 1)[1]).exists()
    # A torn manifest counts for nothing.
    (tmp_path / "v" / "_manifests").mkdir(parents=True)
    (tmp_path / "v" / "_manifests" / "00000001.json").write_text('{"fol')
    assert spark.read.parquet(CO.published(spark, str(tmp_path / "v"), write(4))).count() == 4


def test_sink_rows_with_missing_fields(spark):
    at = F.to_timestamp(F.lit("2024-03-01 10:20:30"))
    cols = "package_id long, name string, namespace string, release_ts timestamp, result string, tar_name string, user_name string, user_email string"
    df = spark.createDataFrame([(1, None, "n", None, "null", "t", "u", "e"), (2, "a" * 99, None, None, "abuse", "t", "", None),
                                (3, "b", "n", None, "rdm_n", "t", "u", "e")], cols).withColumn("release_ts", F.when(F.col("package_id") < 3, at))
    img = {r.package_id: r for r in L.image_sink_rows(df, at).collect()}
    assert (img[1].name, img[1].author, img[1].date_registered, img[1].date, img[1].docker_id) == ("null", "null", "null", "2024-03-01 10:20:30", "1")
    assert (img[2].author, img[2].last_updated, img[3].date_registered) == ("null", "2024-03-01 10:20:30", "null")
    npm = {r.package_id: r for r in L.npm_sink_rows(df, at).collect()}
    assert (len(npm[2].name), npm[2].user_name, npm[2].user_email, npm[2].release_date, npm[2].year) == (95, "NULL", "NULL", "2024-03-01", 2024)
    assert (npm[3].user_name, npm[3].release_date, npm[3].year) == (None, None, None)
    nug = L.nuget_sink_rows(df.select("package_id", F.lit("").alias("file_name"), F.lit(None).cast("string").alias("author"), "release_ts", "result",
                                      F.lit(None).cast("string").alias("urls")), at).first()
    assert (nug.name, nug.author, nug.urls) == ("null", "null", "no_url")

"""Learners, archives, nearest neighbours, components and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from regscope.llm import components, language_id, toxicity, vp_tree, warc
from regscope.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
BAD = ["idiotic", "worthless", "scumlike", "pathetic", "moronic"]


def corpus(rng, n):
    out = []
    for i in range(n):
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.25
        for _ in range(toxic * rng.randrange(2, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t, _ in rows] + [(9000, None, None, 1), (9001, "", "x", 1), (None, "word1", "x", 1), (3, rows[3][1], "en", 1)],
                                 "doc_id long, text string, lang string, _toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(1, rows[1][2]), (None, 1), (7777, 1), (9001, None)], "doc_id long, toxic int")
    w = toxicity.fit(docs, labels)
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(F.col("text"), w).alias("s")).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r.s >= 0.7, truth[r.doc_id] == 1) for r in got if r.h and r.doc_id in truth]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(a == b for a, b in held) / len(held) > 0.95 and all(0 <= r.s <= 1 for r in got) and len(got) == 1504
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 900 < kept.count() < 1350
    # Labels of held-out rows are not read.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(w, toxicity.fit(docs, flipped))
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert docs.select(toxicity.score(F.col("text"), none).alias("s")).agg(F.max("s")).first()[0] == 0.0
    assert docs.limit(0).select(toxicity.score(F.col("text"), toxicity.fit(docs.limit(0), labels.limit(0)))).count() == 0


def test_risk_is_not_driven_below_zero():
    """With few positives a plain corrected risk would fall far below zero."""
    rng = np.random.default_rng(2)
    p = [np.unique(rng.integers(0, 300, 30)).astype(np.int32) for _ in range(40)]
    u = [np.unique(rng.integers(0, 300, 30)).astype(np.int32) for _ in range(400)]
    w = toxicity.nnpu_fit(p, u, 0.3, epochs=60)
    z_p, z_u = toxicity.margins(p, w), toxicity.margins(u, w)
    assert np.logaddexp(0, z_u).mean() - 0.3 * np.logaddexp(0, z_p).mean() > -0.2


def test_language_id(spark):
    rng = random.Random(3)
    made = {"aa": ["the", "of", "and", "thing", "with"], "bb": ["der", "und", "nicht", "schön", "auf"], "cc": ["это", "как", "для", "что", "они"]}
    rows = [(i, " ".join(rng.choice(made[lang]) for _ in range(rng.randrange(3, 60))), lang)
            for i in range(600) for lang in [rng.choice(list(made))]]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 -- 5", "bb"), (1003, "the of and", None), (None, "der und", "bb"), (4, rows[4][1], rows[4][2])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs)
    got = language_id.predict(docs, model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) and len(got) == len(rows) + 6
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003].lang_pred == "aa"
    assert by_id[1000].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    far = language_id.predict(spark.createDataFrame([(1, "ქართული ენა")], "doc_id long, text string"), model, reject=0.3).first()
    assert far.rejected
    none = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_long_texts_are_counted_alike_in_pieces(monkeypatch):
    text = "Über die  Straße, 12 Häuser! " * 50
    whole = language_id.counts(text)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert (language_id.counts(text) == whole).all()


# -- archives ----------------------------------------------------------------
def pages(spark, rows):
    return spark.createDataFrame(rows, "record_id long, uri string, payload binary, first string")


def test_warc_round_trip(spark):
    rows = [(5, "http://a/x y", b"same", "c"), (2, None, b"same", "c"), (9, "u", b"same", "c"), (3, "u", None, "c"), (4, "u", b"", "c"),
            (6, "u", b"\r\n\r\nWARC/1.1\r\n" * 3, "c"), (7, "u", bytes(range(256)) * 900, "c"), (None, "u", b"solo", "c")]
    planned = warc.plan_records(pages(spark, rows))
    got = {r.record_id: r for r in warc.read_warc(spark, warc.write_warc(planned, records_per_file=3)).collect()}
    assert len(got) == len(rows) and all(r.fault is None for r in got.values())
    for i, uri, payload, _ in rows:
        r, data = got[i], payload or b""
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(j for j, _, p, _ in rows if (p or b"") == data and j is not None) if i is not None else None
        assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert got[5].uri == "http://a/x%20y"
    least = warc.plan_records(pages(spark, rows), least_bytes=5).where("record_type = 'revisit'")
    assert least.count() == 0
    assert warc.plan_records(pages(spark, rows).limit(0)).count() == 0


def record(i, payload):
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return warc.record_bytes("response", i, "http://x/", payload, digest, len(payload), None, "2000-01-01T00:00:00Z")


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    rng = random.Random(6)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(30)]
    parts = [gzip.compress(record(i, p)) if zipped else record(i, p) for i, p in enumerate(payloads)]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data = bytearray(b"".join(parts))
    for k in (4, 17):  # damage inside a record
        mid = int(at[k]) + len(parts[k]) - 12
        data[mid:mid + 4] = bytes(x ^ 0x55 for x in data[mid:mid + 4])
    cut = bytes(data[:int(at[29]) + len(parts[29]) // 2])           # the last one is cut off
    cut = cut[:int(at[10])] + b"\x00junk\x1f\x8b\x08 junk" + cut[int(at[10]):]  # and junk between two
    salvage = warc.Salvage(cut)
    got = {h["warc-record-id"]: block for _, h, block in salvage.records()}
    want = {f"<urn:record:{i}>": p for i, p in enumerate(payloads) if i not in (4, 17, 29)}
    assert got == want
    covered = sum(b - a for a, b, _ in salvage.gaps) + sum(len(parts[i]) for i in range(30) if i not in (4, 17, 29))
    assert covered == len(cut) and len(salvage.gaps) == 4 and all(why for _, _, why in salvage.gaps)
    assert list(warc.Salvage(b"").records()) == []
    nothing = warc.Salvage(b"nothing here \x1f\x8b\x08")
    assert list(nothing.records()) == [] and nothing.gaps[0][:2] == (0, 16)


def test_gaps_are_rows(spark, tmp_path):
    good, bad = record(1, b"abc"), bytearray(gzip.compress(record(2, b"def")))
    bad[-6] ^= 1
    (tmp_path / "a.warc").write_bytes(good + bytes(bad) + good.replace(b"record:1", b"record:3"))
    got = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.record_id for r in got if r.fault is None] == [1, 3]
    gap = next(r for r in got if r.fault)
    assert (gap.offset, gap.gap_end) == (len(good), len(good) + len(bad))


# -- nearest neighbours --------------------------------------------------------
def plain_product(a, b):
    total = 0.0  # sum() would compensate
    for x, y in zip(a, b):
        total += x * y
    return total


def test_search_is_exact_and_recall_falls_slowly(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vecs = [(centres[rng.integers(12)] + 0.3 * rng.normal(size=16)).tolist() for _ in range(1500)]
    vecs[7] = vecs[8] = vecs[1400]  # ties
    rows = [(i, v, 0) for i, v in enumerate(vecs)] + [(3, vecs[3], 0), (2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0),
                                                      (2060, [None] + vecs[0][1:], 0), (2080, [float("inf")] * 16, 0), (2100, [1.0, 2.0], 0), (None, vecs[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    got = vp_tree.search(df, F.col("vec_id") % 20 == 0, shard=400, block=30).collect()
    want = {}
    for q in range(0, 1500, 20):
        s = [plain_product(vecs[q], v) for v in vecs]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:20]
        want[q] = [(i, s[i]) for i in order]
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by_query == want
    loose = vp_tree.search(df, F.col("vec_id") % 20 == 0, shard=400, block=30, factor=0.8).collect()
    hits = sum((r.vec_id in {i for i, _ in want[r.query_id]}) for r in loose)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert vp_tree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vp_tree.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def test_toxicity_samples_one_row_an_id(spark, monkeypatch):
    rows = [(i, f"word{i % 7} " + ("scumlike" if i % 3 == 0 else "fine")) for i in range(300)]
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    docs = spark.createDataFrame([*rows, *[learnt[0]] * 500, *[learnt[1]] * 500], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sizes, real_fit, real_calibrate = [], toxicity.nnpu_fit, toxicity.calibrate
    monkeypatch.setattr(toxicity, "nnpu_fit", lambda p, u, *a: sizes.extend([len(p), len(u)]) or real_fit(p, u, *a))
    monkeypatch.setattr(toxicity, "calibrate", lambda w, c, y: sizes.append(len(c)) or real_calibrate(w, c, y))
    toxicity.fit(docs, labels)
    assert len(sizes) == 3 and sizes[0] <= 100 and sizes[0] + sizes[2] <= 400 and sizes[1] + sizes[2] <= 300


def test_nearest_with_one_very_long_vector(spark):
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(900, 16))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    vecs[7] *= 1e7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vp_tree.search(df, F.col("vec_id") % 30 == 0, k=10, shard=300).collect()}
    for q in range(0, 900, 30):
        s = [plain_product(vecs[q].tolist(), v.tolist()) for v in vecs]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        assert [got[q, r + 1] for r in range(10)] == order


def test_pruning_visits_less():
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(400, 4)) + 40 * k for k in range(5)])
    seen = []
    for factor in (1.0, 0.5):
        tree = vp_tree.build(pts, np.arange(len(pts)), np.random.default_rng(0), leaf=32)
        s = vp_tree.Search(pts, np.arange(len(pts)), pts[:50] + 0.01, np.full(50, -1), 5, factor)
        s.run(tree, np.arange(50))
        seen.append(s.visited)
    assert seen[1] <= seen[0] < 50 * len(pts) / 2


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)]
    up = {}

    def root(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: root(v) for e in edges for v in e if e[0] != e[1] or v in got}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- queries ---------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(got.select(*names).collect()) == order(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, SMALL), name)
        assert now.columns == docs.columns
        if name == "ngram_jaccard":
            kept = now.count()
            from regscope.llm.ngram_join import ngram_join
            again = ngram_join(now)
            assert again.where("n_links > 0").count() == 0 and 100 < kept < 200
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert last.count() == now.count() > 0
    assert last.where("n_tokens <> size(ids) or element_at(ids, -1) <> 2").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == now.count()


def test_warc_of_negative_and_extreme_ids(spark):
    ids = [-5, 0, 7, -(2 ** 63), 2 ** 63 - 1]
    rows = spark.createDataFrame([(i, f"http://x/{i}", bytearray(b"same")) for i in ids], "record_id long, uri string, payload binary")
    got = {r.record_id: r for r in warc.read_warc(spark, warc.write_warc(warc.plan_records(rows))).collect()}
    assert set(got) == set(ids)
    first = min(ids)
    assert {i: r.refers_to for i, r in got.items()} == {i: None if i == first else first for i in ids}

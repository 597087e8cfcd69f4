"""Spelling variants, periodic runs and exact top-k search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regscope.llm import histogram_top_k, periodic_runs, spelling_variants
from regscope.llm.queries import QUERIES

DOCS = "doc_id long, text string, word string, n int, h int, runs string, key string, best int"


def docs(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", 1, 2, "y", "z", 3) for d, t in rows], DOCS).repartition(parts)


def saved(spark, tmp_path, name, df):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# Spelling variants

def brute_words(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 13))) for _ in range(40)] + ["aaaaaaa", "abababab", "ÿÿÿÿÿÿÿÀ"]
    rows = [(0, None), (1, ""), (None, "Lonely lonely"), (2, "short WORDS only")]
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(bases[:1 + rng.randrange(len(bases))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("xy") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((rng.choice([None, i, 7]), rng.choice([" ", "-", "1"]).join(words)))
    return rows + [(9, " ".join(["accommodate"] * 2000 + ["acommodate"] * 150 + ["acomodate"] * 12 + ["acomodat"] * 2))]


def test_spelling_variants(spark, spelled, monkeypatch, tmp_path):
    expected = brute_variants(brute_words(spelled))
    assert any(v[0] and v[1] != v[0] for v in expected.values())  # a chain of forms
    for frequent, longest in ((64, 3), (2, 3), (2, 6)):  # short and long grams
        monkeypatch.setattr(spelling_variants, "FREQUENT", frequent)
        monkeypatch.setattr(spelling_variants, "QMAX", longest)
        got = spelling_variants.spelling_variants(spelling_variants.edited_words(docs(spark, spelled))).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected
        assert len(got) == len(expected)
    sf = saved(spark, tmp_path, "documents", docs(spark, spelled))
    query = QUERIES["op11_spelling_variants"](spark, sf)
    assert query.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert query.count() == len(expected)
    assert spelling_variants.spelling_variants(spelling_variants.edited_words(docs(spark, [(1, None)]).limit(0))).collect() == []


def test_words_one_edit_apart_meet():
    """Whatever the dictionary, they share the key of the zone of the edit."""
    rng = random.Random(4)
    dictionary = [np.random.default_rng(q).choice(np.array([0, 9, 255], np.uint8), spelling_variants.BUCKETS) for q in range(5)]
    keys = lambda w, longer: set(spelling_variants.merged_lists([w], dictionary, longer)[0].tolist())
    for _ in range(300):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(7, 12)))
        i = rng.randrange(len(w))
        assert keys(w, 0) & keys(w[:i] + "c" + w[i + 1:], 0)
        for v in (w[:i] + "c" + w[i:], w[:i] + w[i] + w[i:], w + "c"):
            assert keys(w, 0) & keys(v, 1)


# Periodic runs

def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        j = 0
        while j + q < len(w):
            s = j
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - s + q >= max(24, 3 * q):
                found.setdefault((s, j - s + q), q)
            j += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_planted(d, t):
    w = (t or "").encode().split()
    h = zlib.crc32(str("" if d is None else d).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_digests(d, t):
    w = brute_planted(d, t)
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (d, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            digest(b" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.fixture(scope="module")
def periodic():
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 23), (3, "a\x0b" * 24), (None, "b c " * 40), (None, None), (4, "é é " * 30)]
    for i in range(150):
        w = [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            if len(w) > 30:
                x, p = rng.randrange(len(w)), rng.randrange(1, 30)
                for j in range(x + p, min(len(w), x + p * rng.randrange(2, 9))):
                    w[j] = w[j - p]
        rows.append((i, " ".join(w)))
    return rows + rows[20:25] + [(500, "x y z " * 20000)]


def test_find_runs():
    rng = random.Random(1)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(120))]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int64)).tolist()] == brute_runs(w)
    ones = periodic_runs.find_runs(np.zeros(300_000, np.int64))
    assert ones.tolist() == [[0, 300_000, 1]]


def test_periodic_runs(spark, periodic, tmp_path, monkeypatch):
    small = periodic[:-1]
    key = lambda r: str(r)
    sf = saved(spark, tmp_path, "documents", docs(spark, small))
    got = QUERIES["op12_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((brute_digests(d, t) for d, t in small), key=key)
    # Documents beside each other don't form runs; chunks of a few words change nothing.
    plain = periodic_runs.periodic_runs(docs(spark, periodic, 1)).collect()
    monkeypatch.setattr(periodic_runs, "CHUNK", 100)
    assert sorted(periodic_runs.periodic_runs(docs(spark, periodic, 1)).collect(), key=key) == sorted(plain, key=key)
    long = next(r for r in plain if r.doc_id == 500)
    assert [tuple(r) for r in long.runs] == [(0, 60000, 3)] and long.collapsed == "x y z"
    planted = {(r.doc_id, r.text) for r in periodic_runs.planted(docs(spark, small)).collect()}
    changed = [(d, t) for d, t in small if t and zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 and brute_planted(d, t)]
    assert changed and all((d, b" ".join(brute_planted(d, t)).decode()) in planted for d, t in changed)
    empty = docs(spark, [(1, None)]).limit(0)
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.planted(empty))).collect() == []


# Exact top-k search

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int, width int, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 2, 3, 4) for i, v in rows], VECTORS).repartition(5)


def brute_top(rows, every, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    ints = {i: [math.floor(256 * x) for x in v] for i, v in best.items()}
    most = 2 ** 63 - 1
    out = set()
    for q in ints:
        if q % every == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], x)), -most), most), i) for i, x in ints.items() if i != q and len(x) == len(ints[q]))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_exact_top_k(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(-40, 400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, [0.0] * 6) for i in range(30)]  # many ties
    rows += [(None, rows[3][1]), (50, None), (100, [0.1, None] * 3), (51, [float("nan")] * 6), (150, [float("inf")] * 6)]
    rows += [(5, rows[4][1]), (5, rows[4][1]), (200, rows[9][1])]                 # repeated ids
    rows += [(3000, [1.0, 2.0]), (3050, [2.0, -1.0]), (3001, []), (3100, [])]     # other widths
    small = vectors(spark, rows)
    for options in ({}, {"shard": 37, "block": 3}, {"k": 70, "shard": 50}, {"k": 1000}):
        got = histogram_top_k.top_k(small, F.col("vec_id") % 50 == 0, **options).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == brute_top(rows, 50, options.get("k", 5)), options
    got = QUERIES["op13_exact_top_k"](spark, saved(spark, tmp_path, "embeddings", small))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert set(map(tuple, got.collect())) == brute_top(rows, 50, 5)
    assert histogram_top_k.top_k(small.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert histogram_top_k.top_k(small, F.lit(False)).collect() == []


def test_top_k_of_huge_numbers(spark):
    rng = random.Random(6)
    scales = [1, 1e3, 1e6, 3e7, 1e10, 1e150, 1e308]
    rows = [(i, [rng.gauss(0, 0.3) * rng.choice(scales) for _ in range(5)]) for i in range(200)]
    got = histogram_top_k.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, shard=64).collect()
    most = 2 ** 63 - 1
    ints = {i: [math.floor(256 * x) if abs(x) < 1e300 else int(max(min(256 * x, 1.7976931348623157e308), -1.7976931348623157e308)) for x in v] for i, v in rows}
    expected = set()
    for q in range(0, 200, 10):
        scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], x)), -most), most), i) for i, x in ints.items() if i != q)
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])}
    assert set(map(tuple, got)) == expected

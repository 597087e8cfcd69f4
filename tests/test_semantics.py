"""R1 equals brute force; padding of the semantic block; list distances."""

import math
import random

from pyspark.sql import functions as F

from regscope.operators import semantics as S


def _cos_d(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    return 1 - dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))


def test_mean_distance_rewrite(spark):
    rnd = random.Random(3)
    vocab = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(40)]
    plat = vocab[:5]
    kws = [(1, 0, 10), (1, 1, 11), (2, 0, 12), (2, 1, 99)]  # 99 is out of vocabulary
    v = spark.createDataFrame(vocab, "vec_id long, vec array<double>")
    k = spark.createDataFrame(kws, "package_id long, pos long, vec_id long")
    got = {(r.package_id, r.pos): r.distance for r in S.platform_distance(k, v, v.where("vec_id < 5")).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    for (p, pos, vid) in kws[:3]:
        want = sum(_cos_d(vocab[vid][1], pv) for _, pv in plat) / len(plat)
        assert abs(got[(p, pos)] - want) < 1e-12
    mins = {(r.package_id, r.pos): r.distance for r in S.list_distance(k, v, v.where("vec_id >= 20")).collect()}
    for (p, pos, vid) in kws[:3]:
        want = min(_cos_d(vocab[vid][1], vocab[j][1]) for j in range(20, 40))
        assert abs(mins[(p, pos)] - want) < 1e-12


def test_semantic_padding(spark):
    d = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.1), (2, 1, 0.2), (3, 0, 0.1), (3, 1, 0.2), (3, 2, 0.3)],
                              "package_id long, pos long, distance double")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "package_id long")
    got = {r.package_id: r.semantic for r in S.semantic_vector(d, ids).collect()}
    assert got[1] == [0.1] * 10
    assert got[2] == [0.1, 0.2] * 5
    assert got[3] == [0.1, 0.2, 0.3] * 3 + [0.1]
    assert got[4] == [1.0] * 10


def test_word_keyed_path(spark):
    """Real path: top words -> word-keyed vectors -> platform distances."""
    from regscope.constants import PLATFORM_WORDS
    from regscope.operators import text_features as TF
    rnd = random.Random(5)
    words = PLATFORM_WORDS["docker"][:5] + ["casino", "bonus", "container"]
    vecs = {w: [rnd.uniform(-1, 1) for _ in range(6)] for w in words}
    v = spark.createDataFrame(list(vecs.items()), "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "casino bonus casino container unknownword")], "package_id long, text string")
    rows = TF.clean_tokens(TF.token_rows(docs, "package_id", F.col("text")))
    top = TF.top_words(TF.word_freq(rows, "package_id"), "package_id", 10)
    kw = S.keyword_rows(top)
    plat = S.platform_table(v, "docker")
    got = {r.word: r.distance for r in S.platform_distance(kw, v, plat, key="word").collect()}
    assert set(got) == {"casino", "bonus", "container"}  # unknownword is out of vocabulary
    for w in got:
        want = sum(_cos_d(vecs[w], vecs[p]) for p in PLATFORM_WORDS["docker"][:5]) / 5
        assert abs(got[w] - want) < 1e-12

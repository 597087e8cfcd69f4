"""Keywords from texts into the semantic block."""

from pyspark.sql import functions as F

from regscope.operators import semantics as S
from regscope.operators import text_features as TF
from regscope.plans import keywords as K
from regscope.profiles import IMAGE, NPM

from conftest import SF_SMALL


def test_equal_texts_have_equal_keywords_and_distances(spark):
    text = "Casino bonus casino spin the casino BONUS wheel image of a container"
    rows = spark.createDataFrame([(1, text), (2, "unrelated words here"), (3, text), (4, ""), (5, None)], "package_id long, text string")
    words = TF.keywords(rows, "package_id", F.col("text"), 10)
    listed = {}
    for r in words.orderBy("package_id", "pos").collect():
        listed.setdefault(r.package_id, []).append((r.pos, r.word))
    assert listed[1] == listed[3] and set(listed) == {1, 2, 3}
    assert listed[1][:2] == [(0, "casino"), (1, "bonus")] and "the" not in [w for _, w in listed[1]]
    ids = K.with_vector_id(spark, SF_SMALL, words)
    from regscope.sources import fixtures as FX
    d = S.platform_distance(ids, FX.vectors(spark, SF_SMALL), K.platform_vectors(spark, SF_SMALL, IMAGE))
    vectors = {r.package_id: r.semantic for r in S.semantic_vector(d, rows).collect()}
    assert vectors[1] == vectors[3] != vectors[2]
    assert vectors[4] == vectors[5] == [1.0] * 10


def test_lexicon_meets_words(spark):
    rows = spark.createDataFrame([(1, "alpha beta alpha gamma beta alpha")], "package_id long, text string")
    lexicon = spark.createDataFrame([("alpha", "JJ"), ("beta", "NN")], "word string, tag string")
    kept = TF.keywords(rows, "package_id", F.col("text"), 10, lexicon)
    assert [r.word for r in kept.orderBy("pos").collect()] == ["beta", "gamma"]


def test_npm_keeps_up_to_twenty(spark):
    counts = K.keywords(spark, SF_SMALL, NPM).groupBy("package_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    top = counts.agg(F.max("n"), F.max("last")).first()
    assert tuple(top) == (20, 19)


def test_vector_id_rule(spark):
    import hashlib
    got = spark.range(1).select(K.vector_id(F.lit("casino"), F.lit(500)).alias("i")).first().i
    assert got == int(hashlib.md5(b"casino").hexdigest()[:12], 16) % 520


def test_words_are_counted_inside_the_row(spark):
    text = "Casino bonus casino spin the casino wheel"
    rows = spark.createDataFrame([(1, text), (1, "wheel casino"), (2, text), (None, "bonus"), (None, "spin bonus"), (3, ""), (4, None)],
                                 "package_id long, text string")
    got = TF.text_word_freq(rows, "package_id", F.col("text"))
    by_token = TF.word_freq(TF.clean_tokens(TF.token_rows(rows, "package_id", F.col("text"))), "package_id")
    listed = lambda df: sorted(map(repr, df.select("package_id", "word", "n", "first_pos").collect()))
    assert listed(got) == listed(by_token) and got.schema["n"].dataType == by_token.schema["n"].dataType
    assert ("1", "casino", 4, 0) in [(str(r.package_id), r.word, r.n, r.first_pos) for r in got.collect()]
    # No row per token leaves a text.
    plan = TF.keywords(rows, "package_id", F.col("text"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan


def test_lexicon_meets_the_first_words_of_a_text(spark):
    name = lambda i: "w" + "".join(chr(97 + int(c)) for c in f"{i:03d}")
    often = lambda ids: " ".join(name(i) for i in ids for _ in range(2))
    lexicon = spark.createDataFrame([(name(i), "JJ" if i < 100 else "NN") for i in range(150)], "word string, tag string")
    kept = "alpha beta gamma beta"
    # 2: its first words are all of another kind; 3: fewer than asked for in all; 4 and null: several rows.
    rows = spark.createDataFrame(
        [(1, often(range(100, 150))), (2, often(range(100)) + " " + kept), (3, often(range(5)) + " " + kept), (4, kept), (4, often(range(90, 110))),
         (None, kept), (None, kept + " gamma"), (5, ""), (6, None)], "package_id long, text string")

    def listed(df):
        return sorted(map(repr, df.select("package_id", "rank", "word", "n").collect()))
    k = 3
    assert TF.LOOK_UP * k < 100
    freq = TF.noun_verb_tokens(TF.text_word_freq(rows, "package_id", F.col("text")).withColumnRenamed("word", "token"), lexicon)
    plain = TF.top_words(freq.withColumnRenamed("token", "word"), "package_id", k)
    got = TF.text_top_words(rows, "package_id", F.col("text"), k, lexicon)
    assert listed(got) == listed(plain) and [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in plain.schema]
    # Where the first words decide, nothing is left to look up or to shuffle.
    one = TF.text_top_words(rows.where("package_id in (1, 3, 5, 6)"), "package_id", F.col("text"), k, lexicon)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    assert {(r.package_id, r.rank, r.word) for r in one.collect()} >= {(1, 1, "wbaa"), (3, 1, "beta"), (3, 3, "gamma")}

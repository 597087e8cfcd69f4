"""Code features, gates, tokens, top words, substring counts."""

from pyspark.sql import functions as F

from regscope.functions.text import image_code_features, npm_code_feature
from regscope.operators import text_features as TF
from regscope.operators.gates import gate_image, gate_npm, gate_nuget


def test_image_code_features(spark):
    cases = [
        (1, "", (1.0, 0.0)),                                     # empty overview
        (2, "# Title\nplain", (1.0, 1.0)),                       # markdown, no block
        (3, "# T\n```\na\n```\n~~~\nb\n~~~", (1.0, 0.5)),        # two blocks
        (4, "# T\n</p>", (0.0, 1.0)),                            # html tag resets the flag
        (5, "*  \nplain", (0.0, 1.0)),                           # '* ' only before strip
        (6, "  * item", (1.0, 1.0)),
        (7, "see [a](b) here", (1.0, 1.0)),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "i int, t string")
    got = {r.i: (r.code_md, r.code_blocks) for r in df.select("i", *image_code_features(F.col("t"))).collect()}
    for i, _, want in cases:
        assert got[i] == want, i


def test_npm_code_feature(spark):
    df = spark.createDataFrame([("x",), ("```a```b```c```",)], "t string")
    assert [r[0] for r in df.select(npm_code_feature(F.col("t"))).collect()] == [1.0, 0.5]


def test_image_gate_order(spark):
    rows = [(1, None, "ns", "https://a.b", "community"), (2, "n", "", "https://a.b", "community"),
            (3, "n", "ns", None, "community"), (4, "n", "ns", "no link", "community"),
            (5, "n", "ns", "https://a.b", "official"), (6, "n", "ns", "https://a.b", None),
            (7, "n", "ns", "https://a.b", "community")]
    df = spark.createDataFrame(rows, "package_id int, name string, namespace string, full_description string, filter_type string")
    got = {r.package_id: r.gate for r in gate_image(df).collect()}
    assert got == {1: "null", 2: "null", 3: "no_overview", 4: "overview_no_link", 5: "non-abuse", 6: "score", 7: "score"}


def test_npm_nuget_gates(spark):
    df = spark.createDataFrame([(1, None, "r"), (2, "n", " \n\t"), (3, "n", "ok")], "package_id int, name string, readme string")
    assert {r.package_id: r.gate for r in gate_npm(df).collect()} == {1: "name_n", 2: "rdm_n", 3: "score"}
    nd = spark.createDataFrame([(1, "short"), (2, "x" * 25), (3, "long enough text https://a.b/c")], "package_id int, d string")
    assert {r.package_id: r.gate for r in gate_nuget(nd, F.col("d")).collect()} == {2: "non-abuse", 3: "score"}


def test_top_words_tie_by_first_occurrence(spark):
    df = spark.createDataFrame([(1, "beta alpha beta alpha gamma delta")], "package_id int, text string")
    rows = TF.clean_tokens(TF.token_rows(df, "package_id", F.col("text")))
    top = TF.top_words(TF.word_freq(rows, "package_id"), "package_id", 3).orderBy("rank").collect()
    assert [r.word for r in top] == ["beta", "alpha", "gamma"]


def test_stop_words_and_short_tokens(spark):
    df = spark.createDataFrame([(1, "The http x docker 2024 runs")], "package_id int, text string")
    rows = TF.clean_tokens(TF.token_rows(df, "package_id", F.col("text"))).orderBy("pos").collect()
    assert [r.token for r in rows] == ["docker", "runs"]


def test_substring_count(spark):
    df = spark.createDataFrame([(1, "aaaa free freefree")], "package_id int, text string")
    r = TF.lexicon_hits(df, "package_id", F.col("text"), {"x": ["aa", "free"]}).first()
    assert r.x_hits == 2 + 3


def test_dictionary_counts_equal_plain_counts(spark):
    import random
    rnd = random.Random(5)
    word = lambda abc, n: "".join(rnd.choice(abc) for _ in range(rnd.randint(1, n)))
    few = [word("ab", 4) for _ in range(25)]                     # prefixes, repeats, self-overlaps
    many = [word("abcdefghijklmnop", 7) for _ in range(500)]
    odd = ["a.b", "(", "[x]", "é\U0001F600", "\n", "a b", "\\d", "", "#-&~"]
    texts = [word("ab", 60) for _ in range(60)] + [word("abcdefghijklmnop", 400) for _ in range(60)]
    texts += ["", None, "aaaa", "a.b(((\n\n[x][x]é\U0001F600\\d a b#-&~ axb", "ab" * 5000]
    df = spark.createDataFrame([*enumerate(texts)], "package_id long, text string").repartition(4)
    lists = {"few": few, "many": many, "odd": odd, "none": []}
    rows = TF.lexicon_hits(df, "package_id", F.col("text"), lists).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.package_id] or ""
        for name, words in lists.items():
            assert r[f"{name}_hits"] == sum(t.count(w) for w in words if w), (name, t[:50])


def _plain_language(train, text):
    """The same naive Bayes with plain dicts."""
    import math
    from collections import Counter
    from regscope.operators import language as LG

    def grams(t):
        t = (t or "").lower()
        return [sum(ord(c) * k for c, k in zip(t[i:i + 3], LG.TRIGRAM_FACTORS)) % LG.BUCKETS for i in range(len(t) - 2)]
    train = [(x, t) for x, t in train if x is not None]
    per = {}
    for x, t in train:
        per.setdefault(x, Counter()).update(grams(t))
    per = {x: c for x, c in per.items() if c}
    seen = set().union(*per.values())
    got = {}
    for x, c in per.items():
        ll = math.log(sum(y == x for y, _ in train) / len(train))
        got[x] = ll + sum(math.log(c[g] + 1) - math.log(sum(c.values()) + len(seen)) for g in grams(text) if g in seen)
    best = max(got, key=lambda x: (got[x], x))
    return best, 1 / sum(math.exp(v - got[best]) for v in got.values())


def test_language_scores_equal_plain_naive_bayes(spark):
    import random
    from regscope.operators import language as LG
    rnd = random.Random(3)
    abc = {"en": "the aonis ", "fr": "le éuàsnt ", "zh": "\u4e00\u4e01\U0001F600 "}
    text = lambda x, n: "".join(rnd.choice(abc[x]) for _ in range(n))
    train = [(x, text(x, rnd.randint(0, 80))) for x in list(abc) * 30] + [("empty", ""), (None, "the the"), ("en", None)]
    texts = [text(x, n) for x in abc for n in (0, 1, 2, 3, 9, 40)] + [None, "xyz" * 70_000, text("en", 70_000)]
    rows = spark.createDataFrame(train, "lang string, text string").repartition(3)
    model = LG.fit_language_model(rows, F.col("text"))
    out = LG.score_language(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), "doc_id", F.col("text"), model)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        lang, p = _plain_language(train, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.p_lang - p) < 1e-6, (r, lang, p)
    nothing = LG.fit_language_model(rows.where("false"), F.col("text"))
    assert LG.score_language(spark.createDataFrame([(1, "the")], "doc_id long, text string"), "doc_id", F.col("text"), nothing).first().lang_pred is None


def test_language_model_from_text(spark):
    from regscope.operators import language as LG
    en = ["the cat sat on the mat with the other cats", "this is the house that we built there"]
    fr = ["le chat est sur le tapis avec les autres", "c'est la maison que nous avons construite"]
    train = spark.createDataFrame([(i, "en", t) for i, t in enumerate(en)] + [(10 + i, "fr", t) for i, t in enumerate(fr)],
                                  "doc_id long, lang string, text string")
    model = LG.fit_language_model(train, F.col("text"))
    test = spark.createDataFrame([(100, "the other house there"), (101, "la maison avec les chats")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.is_english) for r in LG.score_language(test, "doc_id", F.col("text"), model).collect()}
    assert got[100][0] == "en" and got[101] == ("fr", False)


def test_segmenter_ranks_and_uses_every_word(spark):
    import itertools
    import math
    from regscope.operators import language as LG
    # More words than any earlier bound of the table, the rarest last in rank.
    words = ["".join(c) for c in itertools.islice(itertools.product("bcdfghjk", "aeiou", "lmnprst", "aeiou", "vwxz", "aeiou", "bdgkt"), 60_000)]
    rows = [(" ".join(words[i:i + 500]),) for i in range(0, 60_000, 500)] + [("zebra zebra zebra quux quux zyzzyva",)]
    costs = LG.word_costs(spark.createDataFrame(rows, "text string").repartition(4), F.col("text")).collect()
    order = ["zebra", "quux", *sorted([*words, "zyzzyva"])]
    got = {r.w: r.cost for r in costs}
    assert len(costs) == len(got) == 60_003
    assert all(abs(got[w] - math.log(r * math.log(60_003))) < 1e-9 for r, w in enumerate(order, 1))

    def plain(s, ml=max(map(len, got))):
        best, back = [0.0], [0]
        for i in range(1, len(s) + 1):
            c, k = min((best[k] + got.get(s[k:i], 1e3 * (i - k)), k) for k in range(max(0, i - ml), i))
            best.append(c)
            back.append(k)
        out, i = [], len(s)
        while i:
            out.append(s[back[i]:i])
            i = back[i]
        return out[::-1]
    texts = ["Zyzzyva zebra-quux 42", words[-1] + words[7] + "qqqqqqqqqqqq" + words[59_000], "", None, "qq é\U0001F600 zebra", *[" ".join(words[i::7000]) for i in range(40)]]
    docs = spark.createDataFrame([*enumerate(texts), (None, "zyzzyva quux")], "doc_id long, text string")
    found = {}
    for r in LG.segment(docs, "doc_id", F.col("text"), spark.createDataFrame(costs)).collect():
        found.setdefault(r.doc_id, {})[r.pos] = r.token
    assert [found[0][p] for p in range(3)] == ["zyzzyva", "zebra", "quux"] and found[None] == {0: "zyzzyva", 1: "quux"}
    squeezed = {r.doc_id: r.s or "" for r in docs.select("doc_id", LG.squeezed(F.col("text")).alias("s")).collect()}
    for i in range(len(texts)):
        assert [t for _, t in sorted(found.get(i, {}).items())] == plain(squeezed[i]), i


def test_segmenter_blocks_are_tasks_of_their_own(spark, monkeypatch):
    from regscope.operators import language as LG
    monkeypatch.setattr(LG, "BLOCK_CHARS", 200)
    monkeypatch.setattr(LG, "PART_CHARS", 7)
    costs = spark.createDataFrame([("zebra", 1.0), ("quux", 2.0), ("ze", 0.5), ("bra", 0.6), ("q", 3.0)], "w string, cost double")
    unit, split = "zebra zequux q é\U0001F600ééééééé bra", ["zebra", "ze", "quux", "q", "ééé", "ééééé", "bra"]
    texts = spark.createDataFrame([(i, " ".join([unit] * (i % 4))) for i in range(60)], "doc_id long, text string")
    out = LG.segment(texts, "doc_id", F.col("text"), costs).select("*", F.spark_partition_id().alias("part"))
    rows = out.collect()
    assert len({r.part for r in rows}) > 3
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.pos] = r.token
    for i in range(60):
        tokens = [t for _, t in sorted(got.get(i, {}).items())]
        assert tokens == split * (i % 4), (i, tokens)


def test_segmenter_filter_passes_words_and_grows_with_them(spark, monkeypatch):
    import itertools
    from regscope.operators import language as LG
    words = ["".join(c) + "tail" for c in itertools.islice(itertools.product("bcdfghjklm", repeat=4), 5000)]
    costs = spark.createDataFrame([(w, 1.0) for w in words], "w string, cost double")
    table, longest = LG._word_filter(costs)
    found = list(LG._passing("\n".join(words[:2000]), table, longest))
    # Whole words pass, their beginnings (seven a word) don't, but for a few.
    assert set(words[:2000]) <= set(found) and len(found) == len(set(found)) < 2200
    monkeypatch.setattr(LG, "SLOTS", 1 << 6)
    grown, _ = LG._word_filter(costs)
    assert len(grown) == 8192 and set(words[:2000]) <= set(LG._passing("\n".join(words[:2000]), grown, longest))
    monkeypatch.setattr(LG, "MOST_SLOTS", 1 << 10)
    full, _ = LG._word_filter(costs)
    assert len(full) == 1024 and set(words[:2000]) <= set(LG._passing("\n".join(words[:2000]), full, longest))


def test_language_gate_tells_every_trigram_apart(spark):
    from regscope.operators import language as LG
    # Two trigrams a former table of 65,536 hashed trigrams held in one place.
    place, pair = {}, None
    for n in range(1 << 17):
        t = chr(0x4E00 + n % 4096) + chr(0x6000 + n // 4096) + "x"
        at = sum(ord(c) * k for c, k in zip(t, (1_000_003, 10_007, 101))) % (1 << 16)
        if at in place:
            pair = place[at], t
            break
        place[at] = t
    train = spark.createDataFrame([("en", pair[0] * 9), ("fr", pair[1] * 9)], "lang string, text string")
    model = LG.fit_language_model(train, F.col("text"))
    texts = spark.createDataFrame([(0, pair[0]), (1, pair[1]), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, round(r.p_lang, 6)) for r in LG.score_language(texts, "doc_id", F.col("text"), model).collect()}
    assert got == {0: ("en", round(10 / 11, 6)), 1: ("fr", round(10 / 11, 6)), 2: ("fr", 0.5)}

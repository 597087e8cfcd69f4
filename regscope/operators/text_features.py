"""Keyword extraction as Spark jobs (F6 split path, F7, F8, F9, A13, A14, W2, W3).

tokens (row-local) -> clean (row-local stop-word test, an InSet) ->
noun/verb filter (semi-join with a lexicon table) -> word counts per
(package, word) with map-side combine -> top-k per package with a window whose
partial WindowGroupLimit runs before the exchange.
"""

from __future__ import annotations

import functools
import glob
import os
import re
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import is_alpha, tokens
from ..session import cut_lineage
from .semantics import keyword_rows

# Words of a text, per word asked for, that are looked up in the lexicon first.
LOOK_UP = 6


@functools.lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """Spark's built-in English stop words plus the six fixed extras.

    Read from the MLlib jar, the file that ``StopWordsRemover`` loads, so the
    list needs no running JVM. Without the jar this is an error: a shorter list
    would change every keyword.
    """
    import pyspark
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    jars = [j for h in homes if h for j in glob.glob(os.path.join(h, "jars", "spark-mllib_*.jar"))]
    if not jars:
        raise FileNotFoundError("no spark-mllib jar under SPARK_HOME or pyspark: the stop words can't be read")
    with zipfile.ZipFile(jars[0]) as z:
        words = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode("utf-8").split()
    return tuple(dict.fromkeys([*words, *C.EXTRA_STOP_WORDS]))


def token_rows(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, pos, token)``: every letter run of the lower-cased text."""
    return (df.select(id_col, F.posexplode(tokens(text)).alias("pos", "token"))
            .select(id_col, F.col("pos").cast("long").alias("pos"), "token"))


def keep_token(token: Column) -> Column:
    """not a stop word and longer than one character."""
    return (F.char_length(token) > 1) & ~token.isin(list(stop_words()))


def clean_tokens(rows: DataFrame) -> DataFrame:
    return rows.where(keep_token(F.col("token")))


def noun_verb_tokens(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """F8: drop words the lexicon tags as something other than noun or verb;
    words missing from the lexicon are kept (a tagger calls them nouns)."""
    return rows.join(other_words(lexicon), "token", "left_anti")


def other_words(lexicon: DataFrame) -> DataFrame:
    """The words that the lexicon tags as something other than noun or verb, once each, as ``token``."""
    return lexicon.where(~(F.col("tag").startswith("N") | F.col("tag").startswith("V"))).select(
        F.col("word").alias("token")).distinct()


def word_freq(rows: DataFrame, id_col: str) -> DataFrame:
    """``(id, word, n, first_pos)``."""
    return rows.groupBy(id_col, F.col("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


def _row_word_freq(texts: DataFrame, id_col: str, first: int | None = None) -> DataFrame:
    """A14 of rows ``(id, _text)`` by themselves: the tokens are sorted inside the row, each run of
    one word is a count and its first token the first position. No row meets another.

    With ``first`` only that many words of a text, in the order of W2, and ``_more``: whether it has others."""
    kept = F.filter(F.transform(tokens(F.col("_text")), lambda t, i: F.struct(t.alias("token"), i.cast("long").alias("pos"))),
                    lambda s: keep_token(s["token"]))
    token = lambda i: F.get(F.col("_s"), i)["token"]
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1))
    begins = F.filter(places, lambda i: (i == 0) | (token(i) != token(i - 1)))
    word = lambda b: F.get(F.col("_s"), b)["token"].alias("word")
    n = lambda b, j: (F.coalesce(F.get(F.col("_b"), j + 1), F.size("_s")) - b).cast("long")
    pos = lambda b: F.get(F.col("_s"), b)["pos"].alias("first_pos")
    rows = texts.select(id_col, F.sort_array(kept).alias("_s")).select(id_col, "_s", begins.alias("_b"))
    # The runs are made in the generator: a projection of their own would be merged with that of ``_b``.
    if first is None:
        return rows.select(id_col, F.inline(F.transform("_b", lambda b, j: F.struct(word(b), n(b, j).alias("n"), pos(b)))))
    runs = F.sort_array(F.transform("_b", lambda b, j: F.struct((-n(b, j)).alias("_less"), pos(b), word(b))))
    return (rows.select(id_col, (F.size("_b") > first).alias("_more"), F.inline(F.slice(runs, 1, first)))
            .select(id_col, "_more", "word", (-F.col("_less")).alias("n"), "first_pos"))


def _several(df: DataFrame, id_col: str) -> DataFrame:
    """The ids that several rows have, as ``_id``, from the ids alone."""
    return cut_lineage(df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id"))


def _summed(freq: DataFrame, id_col: str) -> DataFrame:
    return freq.groupBy(id_col, "word").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def text_word_freq(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """A14 from texts: ``(id, word, n, first_pos)`` of the kept words.

    A text is counted inside its row. Only ids that several rows have need their rows'
    counts added up; those ids are found first."""
    texts = df.select(id_col, text.alias("_text"))
    several, same = _several(df, id_col), F.col(id_col).eqNullSafe(F.col("_id"))
    again = _summed(_row_word_freq(texts.join(several, same, "left_semi"), id_col), id_col)
    return _row_word_freq(texts.join(several, same, "left_anti"), id_col).unionByName(again)


def top_words(freq: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k most frequent words, ties by first occurrence (stable sort)."""
    w = Window.partitionBy(id_col).orderBy(F.col("n").desc(), F.col("first_pos").asc())
    return (freq.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select(id_col, F.col("rank").cast("long").alias("rank"), "word", "n"))


def text_top_words(df: DataFrame, id_col: str, text: Column, k: int, lexicon: DataFrame | None = None) -> DataFrame:
    """W2 from texts: ``(id, rank, word, n)``.

    The lexicon (F8) meets the first ``LOOK_UP * k`` words of a text. If k of them stay, or the text has no
    more, they decide; only the other texts, and ids of several rows, look up all their words."""
    if lexicon is None:
        return top_words(text_word_freq(df, id_col, text), id_col, k)
    texts, first = df.select(id_col, text.alias("_text")), LOOK_UP * k
    several, same = _several(df, id_col), F.col(id_col).eqNullSafe(F.col("_id"))
    heads = _row_word_freq(texts.join(several, same, "left_anti"), id_col, first).withColumnRenamed("word", "token")
    tagged = heads.join(other_words(lexicon).withColumn("_other", F.lit(True)), "token", "left")
    # At most ``first`` rows an id.
    kept = F.sort_array(F.collect_list(F.when(F.col("_other").isNull(), F.struct(
        (-F.col("n")).alias("less"), "first_pos", F.col("token").alias("word")))))
    tops = cut_lineage(tagged.groupBy(id_col).agg(F.max("_more").alias("_more"), F.slice(kept, 1, k).alias("_top"))
                       .select(id_col, "_top", (F.col("_more") & (F.size("_top") < k)).alias("_open")))
    found = (tops.where(~F.col("_open")).select(id_col, F.posexplode("_top").alias("rank", "t"))
             .select(id_col, (F.col("rank") + 1).cast("long").alias("rank"), F.col("t.word").alias("word"), (-F.col("t.less")).alias("n")))
    rest = several.unionByName(tops.where("_open").select(F.col(id_col).alias("_id")))
    if rest.isEmpty():
        return found
    freq = _summed(_row_word_freq(texts.join(rest, same, "left_semi"), id_col), id_col).withColumnRenamed("word", "token")
    return found.unionByName(top_words(noun_verb_tokens(freq, lexicon).withColumnRenamed("token", "word"), id_col, k))


def keywords(df: DataFrame, id_col: str, text: Column, k: int, lexicon: DataFrame | None = None) -> DataFrame:
    """W2 from texts: ``(id, pos, word)``, the k most frequent words in their order."""
    return keyword_rows(text_top_words(df, id_col, text, k, lexicon), id_col)


def lexicon_from_corpus(rows: DataFrame) -> DataFrame:
    """Stand-in part-of-speech lexicon: each distinct token of the corpus with a
    tag derived from its length (FIXTURES.md §4)."""
    words = rows.select(F.col("token").alias("word")).distinct()
    return words.select("word", F.substring(F.lit("NVJR"), (F.char_length("word") % 4 + 1).cast("int"), 1).alias("tag"))


def platform_words(corpus: DataFrame, key: str, text: Column, k: int = 20) -> DataFrame:
    """Top-k alphabetic, non-stop words per platform corpus.

    A corpus is many documents under one key; a key may hold a large share of
    all rows, so counts are combined map-side per (key, word) before the
    exchange and only the per-word totals reach the window.
    """
    rows = (corpus.select(key, "doc_id", F.posexplode(tokens(text)).alias("pos", "token"))
            .where(is_alpha(F.col("token")) & keep_token(F.col("token"))))
    freq = rows.groupBy(key, F.col("token").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col("first").asc())
    return (freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(key, F.col("rank").cast("long").alias("rank"), "word", "n"))


def _bordered(word: str) -> bool:
    """Whether two occurrences of ``word`` can overlap."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def _prefix_free(words: list[str]) -> list[list[str]]:
    """``words`` in classes where no word starts another (or is there twice), so at most one word
    of a class begins at a place of a text. As many classes as the longest chain of prefixes."""
    classes: list[list[str]] = []
    chain: list[tuple[str, int]] = []              # the prefixes of the present word and their classes
    for w in sorted(words):
        while chain and not w.startswith(chain[-1][0]):
            chain.pop()
        depth = chain[-1][1] + 1 if chain else 0
        if depth == len(classes):
            classes.append([])
        classes[depth].append(w)
        chain.append((w, depth))
    return classes


def _trie_pattern(words: list[str]) -> str:
    """A pattern for prefix-free, distinct words that shares their common beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    heads.pop("", None)
    parts = [re.escape(c) + (_trie_pattern(tails) if any(tails) else "") for c, tails in heads.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _begins(text: Column, words: list[str]) -> Column:
    """The places of ``text`` where a word of ``words`` begins, one pass per class."""
    total = F.lit(0).cast("long")
    for group in _prefix_free(words):
        total = total + F.regexp_count(text, F.lit(f"(?s)(?={_trie_pattern(group)})")).cast("long")
    return total


def dictionary_count(text: Column, words: list[str]) -> Column:
    """Non-overlapping occurrences of each word (left to right), summed; empty words count nothing.

    Occurrences of a word that can't overlap itself are the places where it begins, found for
    the whole list in one pass per prefix-free class. So are those of the others where the text
    has no two that overlap; only a text that has some is counted word by word."""
    t = F.coalesce(text, F.lit(""))
    words = [w for w in words if w]
    bordered = [w for w in words if _bordered(w)]
    total = _begins(t, [w for w in words if not _bordered(w)])
    if bordered:
        # Two overlapping occurrences: the word, then its part beyond the border.
        overlaps = {w + w[len(w) - i:] for w in bordered for i in range(1, len(w)) if w.startswith(w[i:])}
        overlaps = _prefix_free(sorted(overlaps))[0]         # a longer one begins with one of these
        one = lambda n, w: n + ((F.char_length(t) - F.char_length(F.replace(t, w, F.lit("")))) / F.char_length(w)).cast("long")
        slow = F.aggregate(F.array(*[F.lit(w) for w in bordered]), F.lit(0).cast("long"), one)
        total = total + F.when(t.rlike("(?s)" + _trie_pattern(overlaps)), slow).otherwise(_begins(t, bordered))
    return total


def lexicon_hits(df: DataFrame, id_col: str, text: Column, lists: dict[str, list[str]]) -> DataFrame:
    """Per list, the summed substring counts of its words."""
    return df.select(id_col, *[dictionary_count(text, words).alias(f"{name}_hits") for name, words in lists.items()])

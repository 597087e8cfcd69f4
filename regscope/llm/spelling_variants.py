"""Spelling variants: words one edit apart, by an index of variable-length grams.

Words are decomposed into grams of ``QMIN`` to ``QMAX`` code points, with a mark
before and after the word. A gram dictionary says which grams to lengthen: at
each position the gram grows while the dictionary counts it more than ``FREQUENT``
times. The dictionary is built length by length, and a gram is counted only if
all its prefixes are frequent, so rare grams prune everything below them. It is a
table of ``BUCKETS`` saturated counts per length, addressed by a hash: its size is
fixed, and grams that share a bucket only come out longer than need be.

A gram ends where the dictionary says so, looking at no letter beyond its own. So
an edit affects just the grams that hold the edited letter; the others are found
at the same distance from the word's start (left of the edit) or from its end.
A word's letters are cut into ``ZONES`` zones. For each zone the affected grams are
bounded by those that reach into it, and a word one edit away, with the edit in
that zone, shares all the others. So the lists of all the others are merged to their
intersection at once: by one key, made of these grams, their places and the length.
Words of the same length meet for a replaced letter; a word meets one longer by a
letter under the zones of the shorter, behind the zone one place on. Every word
has a key for every zone, so no pair is lost, whatever the dictionary holds. Pairs
that met are verified by their edit distance.

Lists are joined on Spark, where adaptive execution splits a long one.

Cases: null and empty texts have no words. A null id is written as the empty text
where a contract hashes it. Repeated rows count again. A word without a
near word is its own root. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = r"a-zÀ-ÿ"
MIN_LETTERS, MIN_COUNT = 7, 2
QMIN, QMAX, ZONES = 2, 3, 5
FREQUENT = 64                 # words beyond which a gram is lengthened
BUCKETS = 1 << 22             # of the dictionary, per gram length
PAGE = 1 << 12
RATIO = 10                    # a form is at least this many times as frequent


def edited_words(docs: DataFrame, every: int = 31) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, with a letter deleted where
    ``every`` divides the crc32 of ``<doc_id>:<run>``; of at least MIN_LETTERS letters and MIN_COUNT occurrences."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs can't give a word: a deletion only shortens.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{MIN_LETTERS},}}"), F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    hashed = words.select("w", F.crc32(F.concat_ws(":", "d", "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= MIN_LETTERS)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT))


class Batch:
    """The code points of some words, marked, one after the other, with rolling gram hashes."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.code = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.first = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.end = (self.first + self.size)[self.word]
        self.at = np.arange(len(self.code))
        self.hash = np.zeros(len(self.code), np.uint64)
        self.length = 0
        self.grow()

    def grow(self) -> None:
        """Hashes of the grams one letter longer, wherever they end within their word."""
        ahead = np.zeros(len(self.code), np.uint64)
        ahead[:len(ahead) - self.length] = self.code[self.length:]
        h = (self.hash ^ ahead) * np.uint64(0x9E3779B97F4A7C15)
        self.hash = h ^ (h >> np.uint64(29))
        self.length += 1

    def fits(self) -> np.ndarray:
        return self.at + self.length <= self.end

    def bucket(self) -> np.ndarray:
        return ((self.hash * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def gram_dictionary(words: DataFrame) -> list[np.ndarray]:
    """Saturated counts (255 at most) by bucket, of each gram length from QMIN to QMAX."""
    spark = words.sparkSession
    known: list[np.ndarray] = []
    for length in range(QMIN, QMAX + 1):
        shorter = spark.sparkContext.broadcast(known)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                b = Batch(batch["word"].to_list())
                grown = np.ones(len(b.code), bool)
                for q in range(2, length + 1):
                    b.grow()
                    if QMIN <= q < length:
                        grown &= shorter.value[q - QMIN][b.bucket()] > FREQUENT
                bucket, n = np.unique(b.bucket()[grown & b.fits()], return_counts=True)
                yield pd.DataFrame({"page": bucket // PAGE, "slot": bucket % PAGE, "n": n})

        def page(pdf: pd.DataFrame) -> pd.DataFrame:
            full = np.zeros(PAGE, np.uint8)
            full[pdf["slot"]] = np.minimum(pdf["n"], 255)
            return pd.DataFrame({"page": [pdf["page"].iloc[0]], "counts": [zlib.compress(full.tobytes(), 1)]})

        counted = words.select("word").mapInPandas(count, "page long, slot long, n long").groupBy("page", "slot").agg(F.sum("n").alias("n"))
        counts = np.zeros(BUCKETS, np.uint8)
        # At most BUCKETS / PAGE rows of PAGE bytes, whatever the number of words.
        for row in counted.groupBy("page").applyInPandas(page, "page long, counts binary").collect():
            counts[row.page * PAGE:(row.page + 1) * PAGE] = np.frombuffer(zlib.decompress(row.counts), np.uint8)
        known.append(counts)
    return known


def decomposed(words: list[str], dictionary: list[np.ndarray]) -> tuple[Batch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch; start, end (in it), hash and count of the grams of its words, one for each start."""
    b = Batch(words)
    starts = b.at + QMIN <= b.end
    end = b.at.copy()
    key = np.zeros(len(b.code), np.uint64)
    rarity = np.zeros(len(b.code), np.uint8)
    growing = starts
    for q in range(2, QMAX + 1):
        b.grow()
        if q < QMIN:
            continue
        growing = growing & b.fits()
        counts = dictionary[q - QMIN][b.bucket()]
        end[growing], key[growing], rarity[growing] = b.at[growing] + q, b.hash[growing], counts[growing]
        growing = growing & (counts > FREQUENT)
    at = np.flatnonzero(starts)
    return b, at, end[at], key[at], rarity[at]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def merged_lists(words: list[str], dictionary: list[np.ndarray], longer: int) -> np.ndarray:
    """For each word (row) and zone (column) the key of the grams that no edit in the zone can affect.

    With ``longer`` 1 the zones are those of a word that lacks one letter of the zone."""
    b, at, end, gram, _ = decomposed(words, dictionary)
    word = b.word[at]
    begin, stop = at - b.first[word] - 1, end - b.first[word] - 1  # in letters; the front mark is at -1
    letters, size = b.size[word] - 2 - longer, b.size - 2 - longer
    first = np.searchsorted(word, np.arange(len(words)))
    keys = np.empty((len(words), ZONES), np.int64)
    for zone in range(ZONES):
        low, high = letters * zone // ZONES, letters * (zone + 1) // ZONES
        before = stop <= low
        behind = begin >= high + longer
        place = np.where(before, begin, letters + longer - begin + (1 << 32)).astype(np.uint64)
        shared = np.where(before | behind, _mixed(gram ^ _mixed(place)), np.uint64(0))
        whole = _mixed((size * ZONES + zone).astype(np.uint64))
        keys[:, zone] = _mixed(np.add.reduceat(shared, first) ^ whole).view(np.int64)
    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: pairs of the written table ``word, n`` that differ by one inserted, deleted or replaced letter."""
    spark = words.sparkSession
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                own, longer = (merged_lists(batch["word"].to_list(), dictionary.value, k) for k in (0, 1))
                yield batch[["word", "n"]].assign(own=list(own), longer=list(longer))

    posted = written(words.select("word", "n").mapInPandas(post, "word string, n long, own array<long>, longer array<long>"), "spelling-lists")
    lists = posted.select(F.explode("own").alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    meets = posted.select(F.explode(F.concat("own", "longer")).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    one_way = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = lists.join(meets, "key").where(one_way & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """word, root: the end of the chain word -> form. A chain doubles its step each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(rounds):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "spelling-roots")
        now = step.select("word", "root")
        if step.where("further is not null").isEmpty():
            return now
    raise RuntimeError(f"forms have not ended after {rounds} rounds")


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table ``word, n`` of distinct words of at least MIN_LETTERS letters.

    A word's form is its near word of largest n, the smallest in code-point order of
    several, if its n is at least ``ratio`` times the word's."""
    words = written(words.select("word", "n"), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= F.col("n") * ratio
    joined = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(joined.where("form is not null"))
    return joined.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

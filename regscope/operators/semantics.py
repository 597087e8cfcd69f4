"""Word-vector semantics.

* R1 — the mean cosine distance of a word to the platform words equals
  ``1 - u_w . mean_p(u_p)`` with unit vectors ``u``. The mean unit vector of the
  (at most a few dozen) platform words is one scalar subquery; every distinct
  keyword then needs one dot product. No keyword x platform rows exist.
* R6 — only vocabulary words that occur as keywords are touched (semi-join).
* A16 needs the minimum, which R1 cannot give: the unit vectors of the bounded
  word list travel as one scalar-subquery array and each distinct keyword takes
  the minimum over them in a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SEMANTIC_WIDTH


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b)."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def mean_unit_vector(words: DataFrame, vec: str = "vec") -> Column:
    """Scalar subquery: element-wise mean of the unit vectors of ``words``."""
    # The norm is a column beside the exploded components, computed once a word.
    comps = (words.select(vec, norm(F.col(vec)).alias("n")).select("n", F.posexplode(vec).alias("i", "x"))
             .groupBy("i").agg(F.avg(F.col("x") / F.col("n")).alias("m")))
    arr = comps.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return arr.select("c").scalar()


def unit_vector_list(words: DataFrame, vec: str = "vec") -> Column:
    """Scalar subquery: the unit vectors of a bounded word list, as one array."""
    comps = (words.select(vec, F.monotonically_increasing_id().alias("w"), norm(F.col(vec)).alias("n"))
             .select("w", "n", F.posexplode(vec).alias("i", "x")))
    units = comps.groupBy("w").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("u")))), lambda s: s["u"]).alias("u"))
    return units.agg(F.collect_list("u").alias("l")).select("l").scalar()


def in_vocab(keywords: DataFrame, vocab: DataFrame, key: str = "vec_id") -> DataFrame:
    """Keywords that have a vector (out-of-vocabulary words dropped)."""
    return keywords.join(vocab.select(key), key)


def used_vocab(keywords: DataFrame, vocab: DataFrame, key: str = "vec_id") -> DataFrame:
    """The vectors of the words that occur as keywords."""
    return vocab.join(keywords.select(key).distinct(), key, "left_semi")


def platform_distance(keywords: DataFrame, vocab: DataFrame, platform: DataFrame,
                      key: str = "vec_id") -> DataFrame:
    """A15 via R1: ``keywords`` rows with ``distance`` = mean cosine distance to the
    platform words (in-vocabulary keywords only)."""
    # The subquery is projected first; lambdas may only reference columns.
    dist = (used_vocab(keywords, vocab, key).withColumn("_c", mean_unit_vector(platform))
            .select(key, (F.lit(1.0) - dot(F.col("vec"), F.col("_c")) / norm(F.col("vec"))).alias("distance")))
    # One row per distinct keyword. Popular keywords are hot keys on the keyword
    # side: adaptive execution broadcasts this side by its bytes or splits the skew.
    return keywords.join(dist, key)


def list_distance(keywords: DataFrame, vocab: DataFrame, word_list: DataFrame,
                  key: str = "vec_id") -> DataFrame:
    """Per keyword, the minimum cosine distance to any word of the list."""
    dist = (used_vocab(keywords, vocab, key).withColumn("_l", unit_vector_list(word_list))
            .select(key, (F.lit(1.0) - F.array_max(F.transform("_l", lambda p: dot(F.col("vec"), p))) / norm(F.col("vec"))).alias("distance")))
    return keywords.join(dist, key)


def list_distance_summary(dist: DataFrame, packages: DataFrame, id_col: str = "package_id") -> DataFrame:
    """[min, max, mean] of the per-keyword minima; [1, 1, 1] without any."""
    agg = dist.groupBy(id_col).agg(F.min("distance").alias("d_min"), F.max("distance").alias("d_max"),
                                   F.avg("distance").alias("d_mean"))
    out = packages.select(id_col).join(agg, id_col, "left")
    return out.select(id_col, *[F.coalesce(F.col(c), F.lit(1.0)).alias(c) for c in ("d_min", "d_max", "d_mean")])


def semantic_vector(dist: DataFrame, packages: DataFrame, id_col: str = "package_id",
                    width: int = SEMANTIC_WIDTH) -> DataFrame:
    """The keyword distances in keyword order, repeated cyclically up to
    ``width`` values; ``width`` ones when the package has none.

    ``dist`` holds at most ``width`` rows per package (the caller keeps the
    first keywords), so the per-package list is bounded.
    """
    lists = dist.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "distance"))), lambda s: s["distance"]).alias("d"))
    n = F.size("d")
    padded = F.when(F.col("d").isNull() | (n == 0), F.array_repeat(F.lit(1.0), width)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col("d"), i % n)))
    return packages.select(id_col).join(lists, id_col, "left").select(id_col, padded.alias("semantic"))


def platform_table(vectors: DataFrame, platform: str, word_col: str = "word") -> DataFrame:
    """The vectors of one platform's fixed 20-word vocabulary (word-keyed
    vector tables, S8); words missing from the table simply drop out, as the
    mean runs over in-vocabulary platform words."""
    from ..constants import PLATFORM_WORDS
    return vectors.where(F.col(word_col).isin(PLATFORM_WORDS[platform]))


def keyword_rows(top: DataFrame, id_col: str = "package_id") -> DataFrame:
    """W2 output ``(id, rank, word)`` as keyword rows ``(id, pos, word)``."""
    return top.select(id_col, (F.col("rank") - 1).alias("pos"), "word")

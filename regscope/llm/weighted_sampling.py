"""Document fingerprints by consistent weighted sampling, in DataFrame operations.

The terms of a text are its lower-case words, weighted by their counts. For
sample k and a term of weight w, with r and c drawn from Gamma(2, 1) and b
uniform, all derived from the hash of the term and k,

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1),

and the sample is the term (with its t) of the least a. Two texts agree on a
sample with probability equal to the generalised Jaccard similarity of their
weights, sum(min) / sum(max). As a follows from the term, t and k, the least
value itself stands for the pair: the fingerprint keeps 32 bits of its hash.

Plan. Ids alone are range-partitioned to find each document's next one. Texts
are shuffled once by id, joined by the part of the next text that an edit
needs; words, counts and samples then stay in that partitioning, as every later
grouping contains the id. Fingerprints are a narrow written table.

Cases: a null text is empty; a text without words has the fingerprint ``-`` and
is alike only to others without words. Repeated rows with one id are rows of
their own with the same next document; where rows of the next id differ, the
least text is taken. A null id is below all others. A lone document is its own
next one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SAMPLES = 32
SPLIT = r"[\x20\x09-\x0D]+"
NO_ID = -(1 << 63)


def _log_a(term: Column, log_w: Column, k: int) -> Column:
    """ln a of sample k; 24-, 24- and 16-bit uniforms for r and b, two of 32 bits for c."""
    x, y = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    bits = lambda v, shift, n: (F.shiftrightunsigned(v, shift).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) / float(1 << n)
    r = -F.log(bits(x, 40, 24) * bits(x, 16, 24))
    b = bits(x, 0, 16)
    log_c = F.log(-F.log(bits(y, 32, 32) * bits(y, 0, 32)))
    return log_c - r * (F.floor(log_w / r + b) - b + 1)


def samples(words: DataFrame, keys: list[str], carried: list[str], n: int = SAMPLES) -> DataFrame:
    """Minima s0.. per key from rows of (keys, term hash ``h``); null without a term.

    ``carried`` columns may be null in all but one row of a key; their greatest is kept.
    """
    kept = [F.max(c).alias(c) for c in carried]
    counted = words.groupBy(*keys, "h").agg(F.count("*").alias("w"), *kept)
    logged = counted.select(*keys, "h", *carried, F.log(F.col("w").cast("double")).alias("log_w"))
    least = [F.min(F.when(F.col("h").isNotNull(), _log_a(F.col("h"), F.col("log_w"), k))).alias(f"s{k}") for k in range(n)]
    return logged.groupBy(*keys).agg(*kept, *least)


def successors(docs: DataFrame) -> DataFrame:
    """(k, half, next): each distinct id's key, the most code points an edit of it
    needs, and the key of the next id in descending order, around the end."""
    ids = docs.select("k", F.floor(F.char_length("text") / 2).alias("half")).groupBy("k").agg(F.max("half").alias("half"))
    ranged = written(ids.repartitionByRange("k").select("*", F.spark_partition_id().alias("part")), "sampling-ids")
    ends = ranged.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    # One row per range partition: the part below, and for the lowest the one on top.
    below = written(ends.select("part", F.coalesce(
        F.lag("high").over(W.orderBy("part")), F.max("high").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("over")), "sampling-ends")
    inside = F.lag("k").over(W.partitionBy("part").orderBy("k"))
    return written(ranged.select("*", inside.alias("before")).join(below, "part").select(
        "k", "half", F.coalesce("before", "over").alias("next")), "sampling-next")


def edited_fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
                        F.coalesce("text", F.lit("")).alias("text"))
    follow = successors(texts)
    # What the edit of a document takes from the next one, sent to the document.
    wanted = follow.select(F.col("k").alias("to"), "half", F.col("next").alias("k"))
    sent = (texts.join(wanted, "k").select(F.col("to").alias("k"), F.expr("substring(text, 1, half)").alias("head"))
            .groupBy("k").agg(F.min("head").alias("head")))
    size = F.char_length("text")
    half = F.floor(size / 2)
    paired = texts.join(sent, "k").select(
        "k", F.monotonically_increasing_id().alias("row"), size.cast("long").alias("n_chars"), "text",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"),
                 F.expr("substring(head, 1, cast(floor(char_length(text) / 2) as int))")).alias("edited"))
    # The digest goes along as four numbers, on one row of a document only.
    digest = F.sha2("edited", 256)
    parts = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"d{i}") for i in range(4)]
    info = ["n_chars", "d0", "d1", "d2", "d3"]
    sides = paired.select("k", "row", "n_chars", *parts, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    words = sides.select("k", "row", F.col("x.side").alias("side"), *info, F.posexplode(F.split(F.lower("x.t"), SPLIT)).alias("at", "word"))
    hashed = words.select("k", "row", "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("h"),
                          *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in info])
    got = samples(hashed, ["k", "row", "side"], info, n)
    short = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    both = got.groupBy("k", "row").agg(
        *[F.max(c).alias(c) for c in info],
        *[F.max(F.when(F.col("side") == s, short(f"s{k}"))).alias(f"{x}{k}") for s, x in ((0, "m"), (1, "e")) for k in range(n)])
    prints = written(both, "sampling-prints")

    alike = lambda a, b: reduce(add, [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")).cast("int") for k in range(n)]) / float(n)
    shown = lambda a: F.when(F.col(f"{a}0").isNull(), "-").otherwise(
        F.lower(F.concat(*[F.lpad(F.hex(F.col(f"{a}{k}")), 8, "0") for k in range(n)])))
    following = prints.groupBy("k").agg(F.min("row").alias("row")).join(prints, ["k", "row"]).select(
        F.col("k").alias("next"), *[F.col(f"m{k}").alias(f"f{k}") for k in range(n)])
    whole = F.lower(F.concat(*[F.lpad(F.hex(f"d{i}"), 16, "0") for i in range(4)]))
    return prints.join(follow.select("k", "next"), "k").join(following, "next").select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "n_chars", whole.alias("edited_sha256"),
        shown("m").alias("fingerprint"), shown("e").alias("edited_fingerprint"),
        alike("m", "e").alias("near_edited"), alike("m", "f").alias("near_next"))

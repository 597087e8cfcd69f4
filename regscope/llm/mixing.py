"""Mixing sources to target weights.

Tokens are summed per source, a target is derived for every source, and each
document is emitted ``floor(rate)`` times plus one more time with probability
``rate - floor(rate)``, where ``rate = target / source_size``. The extra copy
is decided by a hash of the seed and the document id, so reruns agree.

Targets share ``budget`` times all tokens in proportion to the weights. A
target stops at ``max_repeat`` times its source's size and the excess goes to
the other sources by weight. That fixed point has a closed form: with sources
sorted by ``cap / weight``, the capped ones are a prefix, and the level of the
rest is (budget left) / (weight left). Only the per-source table, one row per
source, is sorted; documents are pre-aggregated before the shuffle, and the hot
source is never gathered.

Cases: a null or empty text has size 0; documents of size 0 follow the same
draw and take 0 tokens. A null source is a source of its own, ordered last.
Repeated rows with one id draw alike. A null id draws as the empty string. A
source without tokens has target 0. An empty table gives an empty result.
Columns other than the id, text and source do not matter and survive in ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, written

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(seed: str, doc_id: Column) -> Column:
    """Uniform in [0, 1): the first 48 bits of md5(seed:id)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long") / F.lit(float(2 ** 48))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeat
    s = totals.select("source", "source_size", weight.alias("w"), cap.alias("cap"))
    # Ascending cap / weight: the sources before a row are capped if this row's level says so.
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select("*", F.sum("source_size").over(everything).alias("all_size"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
                 F.sum("w").over(rest).alias("w_rest"))
    level = (F.col("all_size") * budget - F.col("cap_before")) / F.col("w_rest")
    s = s.select("*", level.alias("level"), (F.col("cap") / F.col("w") >= level).alias("fits"))
    # The first row whose cap holds the level fixes it for all; without one, all are capped.
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "source", "level"))).over(everything)["level"]
    return s.select("source", "source_size",
                    F.coalesce(F.least("cap", F.col("w") * final), F.col("cap")).alias("target"))


def _rated(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Join targets and add ``copies``.

    The targets are read from a written table, so the planner knows their size:
    it broadcasts them below its threshold and else shuffles with skew splitting.
    """
    t = targets.select(F.col("source").alias("_src"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(broadcast_if_small(t), rows["source"].eqNullSafe(t["_src"]), "left").drop("_src")
    copies = F.floor(rate) + (unit_draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", copies.cast("long"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5,
             max_repeat: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = written(source_targets(sized, weights, budget, max_repeat), "targets")
    return _rated(sized, targets, seed).select(
        "doc_id", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5,
        max_repeat: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document row ``copies`` times, with its own columns."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keyed = row.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = written(source_targets(sized, weights, budget, max_repeat), "targets")
    out = _rated(keyed, targets, seed).where("copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_row.*")

"""Author context.

For each scored package, in the author's event order: the first package gets
its own features, the second gets the previous package's features, later ones
get ``0.6 * previous + 0.4 * one-before-previous``. Packages without an author
get their own features and do not build state.

One plan for any author. Rows are range-partitioned by (author, order), so an
author with very many rows, even on one day or without release times, is spread
over as many chunks as its rows fill. Every chunk of an author gets copies of
the last two rows of the two chunks before it, and ``lag`` inside (author,
chunk) then sees the same two predecessors as over the whole author.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONTEXT_DECAY
from ..session import cut_lineage


def _key_cols(author: str, id_col: str) -> list[Column]:
    # Rows without an author each become their own partition (no hot null key).
    a = F.col(author).cast("string")  # numeric keys (user ids) compare as text
    no_author = a.isNull() | (a == F.lit(""))
    return [no_author.alias("_noauth"),
            F.when(no_author, F.col(id_col).cast("string")).otherwise(a).alias("_akey")]


def blend(own: Column, prev1: Column, prev2: Column) -> Column:
    w1, w2 = CONTEXT_DECAY
    return (F.when(prev1.isNull(), own)
            .when(prev2.isNull(), prev1)
            .otherwise(F.zip_with(prev1, prev2, lambda x, y: F.lit(w1) * x + F.lit(w2) * y)))


def author_context(df: DataFrame, author: str, order: list[str], features: str,
                   id_col: str = "package_id", out: str = "ctx", chunks: int | None = None) -> DataFrame:
    """Adds ``out`` (array<double>) computed from the ``features`` array column.

    Null order values come first. ``chunks`` fixes the number of ranges; by
    default it is the number of shuffle partitions. The chunked rows are a
    written table: range bounds are sampled, so both readers must see one run.
    """
    cols = df.columns
    part = ["_noauth", "_akey", "_chunk"]
    ordering = [F.col(c).asc_nulls_first() for c in order]
    ranges = ["_noauth", "_akey", *ordering]
    keyed = df.select("*", *_key_cols(author, id_col))
    ranged = keyed.repartitionByRange(chunks, *ranges) if chunks else keyed.repartitionByRange(*ranges)
    body = cut_lineage(ranged.withColumn("_chunk", F.spark_partition_id()))
    carry = [*order, features]

    # The last two rows of every (author, chunk).
    backwards = Window.partitionBy(*part).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    last2 = (body.where(~F.col("_noauth")).select(*part, *carry).withColumn("_rn", F.row_number().over(backwards))
             .where(F.col("_rn") <= 2))
    # The two chunks before each chunk of an author: one row per author and chunk.
    cw = Window.partitionBy("_noauth", "_akey").orderBy("_chunk")
    before = (last2.where(F.col("_rn") == 1)
              .select("_noauth", "_akey", F.col("_chunk").alias("_dst"),
                      F.array(F.lag("_chunk", 1).over(cw), F.lag("_chunk", 2).over(cw)).alias("_src"))
              .select("_noauth", "_akey", "_dst", F.explode("_src").alias("_chunk")).where(F.col("_chunk").isNotNull()))
    prefix = (last2.drop("_rn").join(before, part)
              .select("_noauth", "_akey", F.col("_dst").alias("_chunk"), *carry, F.lit(True).alias("_prefix")))
    both = body.select("*", F.lit(False).alias("_prefix")).unionByName(prefix, allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy(*ordering)
    f = F.col(features)
    return (both.withColumn(out, blend(f, F.lag(f, 1).over(w), F.lag(f, 2).over(w)))
            .where(~F.col("_prefix")).select(*cols, out))

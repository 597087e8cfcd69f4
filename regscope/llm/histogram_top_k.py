"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, in blocks; no list of pairs and no
matrix of scores outlives the block that made it. What is gathered instead are
histograms of the scores:

1. The range that can hold a query's k-th highest score starts as all that the
   lengths of its vector and of the candidates allow.
2. All shards score the query and count the scores of the range in ``BINS`` bins.
   A shard sends its bins from the top until they hold k scores: the k-th highest
   of all is in none of the lower ones. Counts are added up per query and bin on
   Spark, and the bin where the total from the top reaches k is the next range.
3. Repeat until the range is one value, the exact k-th highest score.
4. All shards score once more and give the candidates above this value, at most
   k - 1 for a query overall, and of those equal to it the smallest ids that can
   still be needed. A ranked window per query breaks the ties by id.

Rows are dealt by a hash of their id into shards of about ``SHARD`` rows, queries
into blocks of about ``BLOCK``, both stored once. A shard is met by every block:
a join on the block's number, which broadcasts the blocks within a checked size.
Inside a task scores are made ``TILE`` queries at a time, as a product of doubles where
all sums stay below 2^53 and of whole numbers otherwise.

Cases: components are floor(scale * x), x as double. Rows without an id, and
vectors that are null or hold a null or non-finite component, take no part. Zero and
empty vectors do. Vectors of different width aren't compared. Of rows that share
an id the least vector counts, once. Scores beyond a long are given, and compared,
as the nearest long. With fewer than k candidates all are returned; an empty table or no
queries give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

K, SCALE = 5, 256
SHARD, BLOCK, TILE = 8192, 8192, 256
BINS = 1024
MOST = 2 ** 63 - 1
EXACT = 2.0 ** 53


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of whole numbers held as doubles (any that doubles hold, beyond a long too)."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    return np.nan_to_num(np.floor(rows), posinf=np.finfo(np.float64).max, neginf=-np.finfo(np.float64).max)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut to the range of a long."""
    width = queries.shape[1]
    sizes = [np.abs(part).max(1, initial=0) if width else np.zeros(len(part)) for part in (queries, rows)]
    most = sizes[0][:, None] * sizes[1][None, :] * max(width, 1)
    if not most.size or most.max() < EXACT:
        return (queries @ rows.T).astype(np.int64)
    out = np.zeros(most.shape, np.int64)
    # Where a row or a query is large, whole numbers of any size, only for those rows and queries.
    large = most >= EXACT
    i, j = np.flatnonzero(large.any(1)), np.flatnonzero(large.any(0))
    fine_i, fine_j = np.flatnonzero(~large.any(1)), np.flatnonzero(~large.any(0))
    out[fine_i] = (queries[fine_i] @ rows.T).astype(np.int64)
    out[np.ix_(i, fine_j)] = (queries[i] @ rows[fine_j].T).astype(np.int64)
    longs = np.array([[int(x) for x in r] for r in queries[i].tolist()], object).reshape(len(i), width)
    for c in j.tolist():
        exact = longs.dot(np.array([int(x) for x in rows[c].tolist()], object))
        out[i, c] = [min(max(int(s), -MOST), MOST) for s in exact]
    return out


def usable(vec: Column) -> Column:
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _packed(rows: DataFrame, group: str, parts: int, label: str) -> DataFrame:
    """One row per (width, group): its ids in order, and their vectors as bytes."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"width": [pdf["width"].iloc[0]], group: [pdf[group].iloc[0]], "ids": [pdf["vec_id"].to_numpy().tobytes()],
                             "vectors": [whole(pdf["v"].to_list()).tobytes()]})
    return written(rows.select("width", group, "vec_id", "v").repartition(parts, "width", group).groupBy("width", group).applyInPandas(
        pack, f"width int, {group} long, ids binary, vectors binary"), label)


def _range_histogram(s: np.ndarray, own: np.ndarray, low: np.ndarray, step: np.ndarray, above: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, bin, count) of the scores in the queries' ranges: bins from the top, until with the
    ``above`` ones beyond the range they hold k scores."""
    # Differences of longs may pass a long, but not an unsigned one.
    off = (s.view(np.uint64) - low.view(np.uint64)[:, None]) // step.astype(np.uint64)[:, None]
    inside = (s >= low[:, None]) & (off < BINS) & ~own
    slot = np.where(inside, off.astype(np.int64), BINS) + np.arange(len(s))[:, None] * (BINS + 1)
    counts = np.bincount(slot.ravel(), minlength=len(s) * (BINS + 1)).reshape(len(s), BINS + 1)[:, :BINS]
    down = counts[:, ::-1]
    before = np.cumsum(down, axis=1) - down + above[:, None]
    q, d = np.nonzero((down > 0) & (before < k))
    return q, BINS - 1 - d, down[q, d]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, shard: int = SHARD, block: int = BLOCK,
          seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id, score of rows (vec_id, embedding): for each row for which ``is_query``
    holds, the k other rows of highest integer score."""
    asked = F.coalesce(is_query, F.lit(False)).alias("is_query")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    used = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding").cast("array<double>")))
    rows = written(used.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), asked)
                   .groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
                   .withColumn("width", F.size("v")), "top-rows")
    # One row per width of vectors: how many shards and blocks bound their sizes.
    sizes = written(rows.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).where("q > 0").select(
        "width", F.ceil(F.col("n") / shard).cast("long").alias("shards"), F.ceil(F.col("q") / block).cast("long").alias("blocks")), "top-sizes")
    dealt = rows.join(broadcast_if_small(sizes), "width")
    spread = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(seed + salt)), F.col(count))
    # As many partitions as shards, so that each is a task's own (and some more beyond 4,096).
    parts = sizes.agg(F.sum("shards"), F.sum("blocks")).first()
    shards = _packed(dealt.withColumn("shard", spread("shards", 0)), "shard", min(parts[0] or 1, 4096), "top-shards")
    asking = dealt.where("is_query").withColumn("block", spread("blocks", 1))
    blocks = _packed(asking, "block", min(parts[1] or 1, 4096), "top-blocks")
    counts = sizes.select("width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    met = shards.join(broadcast_if_small(counts), "width").select("width", "block", "shard", F.col("ids").alias("row_ids"), F.col("vectors").alias("rows"))

    def tiles(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
        """Query ids, candidate ids, scores and the queries' ranges of some queries and a shard."""
        for r in batch.itertuples(index=False):
            ids, mine = np.frombuffer(r.row_ids, np.int64), np.frombuffer(r.ids, np.int64)
            x = np.frombuffer(r.rows, np.float64).reshape(len(ids), r.width)
            y = np.frombuffer(r.vectors, np.float64).reshape(len(mine), r.width)
            state = pd.DataFrame({"query_id": np.frombuffer(r.asks, np.int64), "low": np.frombuffer(r.low, np.int64),
                                  "step": np.frombuffer(r.step, np.int64), "above": np.frombuffer(r.above, np.int64)})
            at = np.searchsorted(mine, state["query_id"])
            for start in range(0, len(state), TILE):
                part = at[start:start + TILE]
                yield mine[part], ids, scores(y[part], x), state.iloc[start:start + TILE]

    def joined(states: DataFrame) -> DataFrame:
        """Shards beside the blocks with the ranges of their queries, as bytes."""
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"width": [pdf["width"].iloc[0]], "block": [pdf["block"].iloc[0]]} | {
                name: [pdf[column].to_numpy(np.int64).tobytes()] for name, column in (
                    ("asks", "query_id"), ("low", "low"), ("step", "step"), ("above", "above"))})
        packed = states.groupBy("width", "block").applyInPandas(
            pack, "width int, block long, asks binary, low binary, step binary, above binary")
        full = written(packed.join(blocks, ["width", "block"]), "top-asks")
        return met.join(broadcast_if_small(full), ["width", "block"])

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, ids, s, state in tiles(batch):
                q, b, n = _range_histogram(s, mine[:, None] == ids[None, :], state["low"].to_numpy(), state["step"].to_numpy(),
                                           state["above"].to_numpy(), k)
                yield pd.DataFrame({"query_id": mine[q], "bin": b, "n": n})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, ids, s, state in tiles(batch):
                kth, above = state["low"].to_numpy()[:, None], state["above"].to_numpy()[:, None]
                other = mine[:, None] != ids[None, :]
                equal = (s == kth) & other
                # ids are in order, so the first equal ones of a shard are the smallest.
                take = ((s > kth) & other) | (equal & (np.cumsum(equal, axis=1) <= k - above))
                q, c = np.nonzero(take)
                yield pd.DataFrame({"query_id": mine[q], "vec_id": ids[c], "score": s[q, c]})

    # Lengths bound the scores; floor(x) is no farther from 0 than |x| + 1.
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + (F.abs(x) + 1) * (F.abs(x) + 1)))
    reach = written(dealt.groupBy("width").agg(F.max(length(F.col("v"))).alias("reach")), "top-reach")
    most = length(F.col("v")) * F.col("reach") * 1.000001 + 2
    bound = F.when(most < 4e18, F.ceil(F.least(most, F.lit(4e18)))).otherwise(F.lit(MOST))
    state = written(asking.join(broadcast_if_small(reach), "width").select("width", "block", F.col("vec_id").alias("query_id"), bound.alias("bound")).select(
        "width", "block", "query_id", (-F.col("bound")).alias("low"), _first_step(F.col("bound")).alias("step"),
        F.lit(0).cast("long").alias("above")), "top-states")
    while not state.where("step > 0").isEmpty():
        counted = joined(state.where("step > 0")).mapInPandas(histograms, "query_id long, bin long, n long")
        state = written(_narrowed(state, counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n")), k), "top-states")
    found = joined(state).mapInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_step(bound: Column) -> Column:
    """The least power of BINS whose BINS steps pass from -bound to bound: a bin is then the whole next range."""
    steps, least = [BINS ** j for j in range(7) if BINS ** j < MOST], None
    for step in reversed(steps):
        fits = F.when(bound < step * BINS // 2, F.lit(step).cast("long")) if step * BINS // 2 < MOST else F.lit(step).cast("long")
        least = fits if least is None else fits.otherwise(least)
    return least


def _narrowed(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The queries' next ranges from their counts by bin; ``step`` 0 says that ``low`` is the k-th highest score."""
    down = W.partitionBy("query_id").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = counts.join(state.select("query_id", "above"), "query_id").select("query_id", "bin", "n", (F.sum("n").over(down) + F.col("above")).alias("held"))
    hit = total.where((F.col("held") >= k) & (F.col("held") - F.col("n") < k)).select("query_id", "bin", (F.col("held") - F.col("n")).alias("over"))
    # A range may be wider than a long holds.
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    low = (wide("low") + (wide("bin") * wide("step")).cast("decimal(20,0)")).cast("long")
    step = F.expr(f"step div {BINS}")
    missed = F.col("bin").isNull()  # fewer than k candidates: all of them count
    new = state.where("step > 0").join(hit, "query_id", "left").select(
        "width", "block", "query_id", F.when(missed, F.lit(-MOST - 1)).otherwise(low).alias("low"),
        F.when(missed, 0).otherwise(step).cast("long").alias("step"), F.when(missed, 0).otherwise(F.col("over")).cast("long").alias("above"))
    return new.unionByName(state.where("step = 0"))

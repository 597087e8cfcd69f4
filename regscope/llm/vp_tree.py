"""Approximate nearest neighbours with vantage-point trees, one per shard.

A search for the largest inner products becomes one for the nearest points: a
vector x gets the extra coordinate sqrt(M^2 - |x|^2) with M the largest norm, a
query gets 0, and then the squared distance is M^2 + |q|^2 - 2 q.x.

Rows are dealt into shards by a hash of their id. A shard's tree splits its
rows at the median distance from a vantage point, down to leaves. Searching
keeps the k best so far; the far side of a split can only hold better ones if
``margin < factor * worst``, where margin is the distance from the query to the
split shell and worst the distance of the k-th best. With ``factor`` 1 this is
the triangle inequality and the search is exact; below 1 more is pruned and
recall falls. Queries go through a tree in blocks, as matrix products.

Every block of queries meets every shard, in tasks of bounded size (``shard``
rows times ``block`` queries); only k rows per query and shard leave a task, and
the k best are taken per query by a ranked window. Both rank by the scores of
the original vectors, in double precision, added component by component.

Cases: vectors that are null, empty, all zero, or hold null or non-finite
components take no part, as rows or queries; so do rows without an id. Vectors
whose width differs from the query's aren't compared with it. Ties go to the
smaller id. Repeated rows (same id) are candidates once. An empty table gives
no rows; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

K = 20
SHARD, BLOCK, LEAF = 8192, 1024, 256


@dataclass
class Node:
    rows: np.ndarray | None = None          # of a leaf
    vantage: int = -1
    radius: float = 0.0                     # inside: at most this far from the vantage point
    inside: "Node | None" = None
    outside: "Node | None" = None


def build(points: np.ndarray, rows: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Node:
    if len(rows) <= leaf:
        return Node(rows=rows)
    # Of a few vantage points, the one whose distances spread most.
    tries = rng.choice(rows, min(5, len(rows)), replace=False)
    probe = points[rng.choice(rows, min(64, len(rows)), replace=False)]
    vantage = int(max(tries, key=lambda v: np.linalg.norm(probe - points[v], axis=1).std()))
    d = np.linalg.norm(points[rows] - points[vantage], axis=1)
    order = np.argsort(d, kind="stable")
    half = len(rows) // 2
    radius = float(d[order[half - 1]])
    return Node(vantage=vantage, radius=radius, inside=build(points, rows[order[:half]], rng, leaf),
                outside=build(points, rows[order[half:]], rng, leaf))


class Search:
    """k rows of a tree with the largest inner products, for a block of queries.

    Without ``vectors`` and ``asked`` (the vectors before lifting), these are the
    nearest points. ``top`` is the largest norm, 0 when nothing was lifted.

    The lifted distance only prunes, with a tolerance for its rounding. Rows are
    ranked by the products of the vectors themselves, added as ``inner_product``
    does; a matrix product with a bound on its error leaves out those that
    cannot be among the best.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float,
                 vectors: np.ndarray | None = None, asked: np.ndarray | None = None, top: float = 0.0):
        self.points, self.ids, self.queries, self.own, self.k, self.factor = points, ids, queries, own, k, factor
        if vectors is None or asked is None:
            # |q - p|^2 = |q|^2 - 2 (q.p - |p|^2 / 2)
            vectors = np.column_stack([points, (points * points).sum(1) / 2])
            asked = np.column_stack([queries, np.full(len(queries), -1.0)])
        self.vectors, self.asked = vectors, asked
        self.lengths, self.asked_lengths = np.linalg.norm(vectors, axis=1), np.linalg.norm(asked, axis=1)
        squares = (queries * queries).sum(1)
        self.reach = squares + top * top                # squared distance: reach - 2 * product
        self.eps = 16 * (points.shape[1] + 8) * np.finfo(np.float64).eps
        self.slack = self.eps * (squares + (float((points * points).sum(1).max()) if len(points) else 0.0))
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visited = 0

    def run(self, node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.rows is not None:
            self._leaf(node.rows, q)
            return
        d = np.linalg.norm(self.queries[q] - self.points[node.vantage], axis=1)
        near_in = d <= node.radius
        for side, near, far in ((near_in, node.inside, node.outside), (~near_in, node.outside, node.inside)):
            mine, margin = q[side], np.abs(d[side] - node.radius)
            self.run(near, mine)
            worst = np.sqrt(np.maximum(self.reach[mine] - 2 * self.best[mine, -1], 0) + self.slack[mine])
            self.run(far, mine[~(margin > self.factor * worst + self.eps * (d[side] + node.radius))])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        x, y = self.asked[q], self.vectors[rows]
        self.visited += len(q) * len(rows)
        about = x @ y.T
        error = self.eps * self.asked_lengths[q][:, None] * self.lengths[rows][None, :]
        other = self.own[q][:, None] != self.ids[rows][None, :]
        least = self.best[q, -1]
        if len(rows) >= self.k:
            sure = np.where(other, about - error, -np.inf)
            least = np.maximum(least, np.partition(sure, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        i, j = np.nonzero(other & ~(about + error < least[:, None]))
        score = np.full(about.shape, -np.inf)
        score[i, j] = products(x[i], y[j])
        allowed = np.full(about.shape, np.iinfo(np.int64).max)
        allowed[i, j] = self.ids[rows][j]
        score = np.concatenate([self.best[q], score], axis=1)
        who = np.concatenate([self.who[q], allowed], axis=1)
        order = np.lexsort((who, -score), axis=1)[:, :self.k]
        self.best[q] = np.take_along_axis(score, order, 1)
        self.who[q] = np.take_along_axis(who, order, 1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with the same of y, rounded as ``inner_product`` rounds."""
    out = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        out += a * b
    return out


def usable(vec: Column) -> Column:
    """Non-empty, all components finite, not all zero."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & ok & F.exists(vec, lambda x: x != 0), F.lit(False))


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, adding from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = K, factor: float = 1.0, shard: int = SHARD,
           block: int = BLOCK, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of rows (vec_id, embedding); queries are the rows
    for which ``is_query`` holds, candidates all other rows than the query's own."""
    rows = written(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("is_query"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id"]).withColumn("width", F.size("v")), "vp-rows")
    sizes = rows.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("int")).alias("q"),
                                      F.sqrt(F.max(inner_product(F.col("v"), F.col("v")))).alias("top"))
    # Shards and blocks by hash, as many as bound their sizes; one row per width of vectors.
    sizes = written(sizes.where("q > 0").select("width", "top", F.ceil(F.col("n") / shard).cast("long").alias("shards"),
                                                F.ceil(F.col("q") / block).cast("long").alias("blocks")), "vp-sizes")
    dealt = rows.join(broadcast_if_small(sizes), "width").select(
        "*", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("shards")).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.col("blocks")).alias("block"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    points = dealt.select("width", "top", "shard", F.explode(every("blocks")).alias("block"), "vec_id", "v", F.lit(False).alias("asks"))
    asking = dealt.where("is_query").select("width", "top", F.explode(every("shards")).alias("shard"), "block", "vec_id", "v", F.lit(True).alias("asks"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        x, q = pdf[~asks].sort_values("vec_id"), pdf[asks].sort_values("vec_id")
        if x.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": []}).astype({"query_id": "int64", "vec_id": "int64"})
        base, ids = np.stack(x["v"].to_list()), x["vec_id"].to_numpy()
        extra = np.sqrt(np.maximum(pdf["top"].iloc[0] ** 2 - (base * base).sum(1), 0))
        lifted = np.column_stack([base, extra])
        own = q["vec_id"].to_numpy()
        asked = np.column_stack([np.stack(q["v"].to_list()), np.zeros(len(q))])
        tree = build(lifted, np.arange(len(ids)), np.random.default_rng(seed))
        found = Search(lifted, ids, asked, own, k, factor, base, asked[:, :-1], float(pdf["top"].iloc[0]))
        found.run(tree, np.arange(len(q)))
        keep = np.isfinite(found.best)
        return pd.DataFrame({"query_id": np.repeat(own, keep.sum(1)), "vec_id": found.who[keep]})

    hits = (points.unionByName(asking).groupBy("width", "shard", "block")
            .applyInPandas(nearest, "query_id long, vec_id long"))
    # Exact scores of the k best of each shard, then the k best of all.
    vec = rows.select("vec_id", "v")
    scored = (hits.select("query_id", "vec_id")
              .join(vec, "vec_id").join(vec.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
              .select("query_id", "vec_id", inner_product(F.col("qv"), F.col("v")).alias("score")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

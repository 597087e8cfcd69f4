"""Connected components of a graph given as edges, on Spark.

Alternating large-star and small-star steps: each round points every node at
the smallest node in its neighbourhood, until nothing moves. Minima are
combined before the shuffle, so a node with very many neighbours is never
gathered; each round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _hooked(arcs: DataFrame, with_self: bool) -> DataFrame:
    """For arcs (u, v): v (and u) pointed at the smallest node around u."""
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = arcs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if with_self:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each component, for nodes with edges.

    ``edges`` has the long columns u and v; direction, repeats and loops don't
    matter. Raises if it has not settled after ``rounds`` rounds.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to the least of u's surroundings.
        large = _hooked_above(both)
        # Small star: u and its smaller neighbours go to the least of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _hooked(down, with_self=True).where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = written(small, label)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(got)
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def _hooked_above(both: DataFrame) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")

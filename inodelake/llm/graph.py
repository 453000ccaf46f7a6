"""Connected components of an edge table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.runtime import written


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (a, b).

    In each round a node is merged into the smallest of its neighbours and itself,
    and only the distinct edges between different merged nodes are left, until
    there are none. A node's neighbours are only ever reduced by min, so one with
    very many edges is summed up before the shuffle. A star goes in one round;
    names in no particular order, as digests are, take about as many rounds as the
    logarithm of the component's size.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots: DataFrame | None = None
    for _ in range(rounds):
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("into")), "merged")
        if roots is None:
            roots = merged.select(F.col("a").alias("node"), F.col("into").alias("root"))
        else:
            roots = written(roots.join(merged, roots["root"] == merged["a"], "left").select("node", F.coalesce("into", "root").alias("root")), "roots")
        x = merged.select(F.col("a").alias("p"), F.col("into").alias("x"))
        y = merged.select(F.col("a").alias("q"), F.col("into").alias("y"))
        moved = left.where("a <> b").join(x, F.col("a") == F.col("p")).select("x", "b").join(y, F.col("b") == F.col("q")).where("x <> y")
        left = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not left.take(1):
            return roots
    raise RuntimeError("the components did not settle")


def pairs_inside(pairs: DataFrame, clusters: DataFrame) -> int:
    """How many of ``pairs`` (a, b) are in one component of ``clusters`` (node, root)."""
    left = clusters.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = clusters.select(F.col("node").alias("b"), F.col("root").alias("y"))
    return pairs.join(left, "a").join(right, "b").where("x = y").count()

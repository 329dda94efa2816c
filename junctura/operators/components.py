"""Connected components of an undirected graph that is spread over a cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Writer = Callable[[DataFrame], DataFrame]
EDGES_A_TASK = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    return both.filter("b > a").join(least, "a").filter("b > to").select(F.col("to").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours go to the least of those. Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("to"))
    rest = edges.join(least, "b").filter("a > to").select(F.col("to").alias("a"), F.col("a").alias("b"))
    return rest.union(least.select(F.col("to").alias("a"), "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most, and that one none: the edges are stars."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("low")), F.struct(F.col("b").alias("node"), F.lit(1).alias("low")))).alias("e"))
    by = ends.groupBy("e.node").agg(F.sum("e.low").alias("lows"), F.count("*").alias("n"))
    return by.filter("lows > 1 or (lows = 1 and n > 1)").isEmpty()


def connected(edges: DataFrame, write: Writer, drop: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """node, root: every node of ``edges`` (columns a, b) with the least node that it can reach.

    Alternates large-star and small-star steps until the edges are stars; the number of rounds grows with
    the logarithm of the graph's size. No node's neighbours are ever gathered: the steps are minima, added
    up where the edges lie, and joins that Spark splits at hot nodes. Each round is written by ``write``,
    so a lost executor costs the tasks it ran. Steps end in as many tasks as the edges need.
    """
    edges = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = write(edges)
    tasks = -(-edges.count() // EDGES_A_TASK)
    while tasks and not _settled(edges):
        before, edges = edges, write(_small_star(_large_star(edges)).coalesce(tasks))
        if drop:
            drop(before)
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)

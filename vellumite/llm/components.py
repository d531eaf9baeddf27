"""Connected components by alternating large-star and small-star steps over an edge table.

Every step is a grouped minimum and a join, written to the shared folder, so lineage stays short and no group of
edges is ever held by one task; a hub's edges are dealt out by Spark's skew handling. The number of steps grows
with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_steps: int = 100) -> DataFrame:
    """(node, component) for every node of the edge table (a, b) that has a neighbour, the component being its smallest node."""
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(most_steps):
        if not before[0]:
            break
        now = written(_small_star(_large_star(now)).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

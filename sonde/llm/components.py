"""Connected components of a graph given as links, in a bounded number of rounds of joins.

Links are (a, b) pairs of longs. Every round joins the links with the smallest neighbour of
each end ("large star" and "small star"): the links become stars around the smallest node of
each component, in a number of rounds that grows with the logarithm of the longest path.
Rounds write their links to the shared folder, so lineage stays short. A node with a great
many links is not gathered anywhere: all steps are joins and aggregates with partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm import scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Ties each larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Ties a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    Self links and repeated links are allowed. Raises if `rounds` rounds were not enough.
    """
    links = scratch.save(links.filter("a <> b").distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    for _ in range(rounds):
        nearer = scratch.save(_small_star(_large_star(links)), "links")
        after = mark(nearer)
        scratch.drop(links)
        links = nearer
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

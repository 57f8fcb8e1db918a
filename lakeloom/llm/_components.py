"""Connected components of a graph whose links lie in a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._durable import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame, keep: str) -> DataFrame:
    """Hangs the neighbours of each node on the least of them: those above the node, or those below and the node itself."""
    least = neighbours.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = neighbours.join(least, "a")
    if keep == "above":
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    below = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node it reaches.

    links: columns a and b of one orderable type. Each round rewires every node to a smaller neighbour, so the
    number of rounds grows with the logarithm of the longest chain. Self-links and nulls link nothing.
    The round's links lie in the checkpoint folder; nothing is collected but two sums.
    """
    links = cut(links.select("a", "b").where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    mark = None
    for _ in range(rounds):
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        mark = tuple(seen)
        large = _star(_both_ways(links), "above").where("a <> b").distinct()
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "below")
        links = cut(small.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")

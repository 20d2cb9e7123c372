"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import materialise

#: Rows of a partition of links.
ROWS = 50_000


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One half step: every node's neighbours (the lesser or the greater ones) move to its least neighbour.

    A node's least neighbour is aggregated before it is shuffled and then joined, so that Spark can split a node that has
    many neighbours over several tasks.
    """
    if small:
        # Of each link the greater end; its lesser neighbours and itself get the least of them.
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def components(links: DataFrame, most: int = 0) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b; `most` rows, if known); nodes that are least are left out.

    Alternates large and small stars until the links no longer change; they then join every node to the least one. A step
    never makes more links than there were.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), ROWS, most)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(links)
    while True:
        links = materialise(_star(_star(links, False), True).distinct(), ROWS, max(1, seen[0]))
        now = mark(links)
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now

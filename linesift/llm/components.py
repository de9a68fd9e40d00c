"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two aggregations and joins. A node's minimum is a written table, so the join with its links has nothing
but shuffled tables on both sides, and adaptive execution splits the links of a node with very many among tasks. Rounds
grow with the logarithm of the longest path, and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """links with a > b. After _large() a node has few of them, as its neighbours have moved to their minima."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    low = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node has one smaller node, which has none: then every component is a star around its smallest node."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.filter((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("least") == 0)).isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: a, b (bigint, any direction, repeated or not). Returns node, root (the smallest node that it reaches), for
    all nodes with links; no rows without links."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = stored(links, "links")
    for _ in range(most_rounds):
        if _settled(links):
            break
        links = stored(_small(_large(links)), "links")
    else:
        raise RuntimeError("components didn't settle")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

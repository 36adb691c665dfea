"""Connected components of links by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolboard.llm.common import stored


def large_star(links: DataFrame) -> DataFrame:
    """Point the larger neighbours of every node at the smallest node around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least"))
    return (both.join(least, F.col("a") == F.col("node")).where("b > a")
            .select(F.col("least").alias("a"), "b").distinct())


def small_star(links: DataFrame) -> DataFrame:
    """Point every node's smaller neighbours, and the node, at the smallest of them; links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "node")
    moved = links.join(least, F.col("b") == F.col("node")).where("a <> least").select(
        F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Nodes that have a link, with the smallest node they reach: node, component.

    ``links`` has columns a and b with a < b. Rounds of two joins each, their number about the logarithm of the longest
    path; each round is written, and ends when the links don't change. A hub is a key of plain joins and sums, which
    Spark splits; nothing gathers a node's neighbours.
    """
    now, last = links.select("a", "b").distinct(), None
    while True:
        now = stored(small_star(large_star(now)), "links")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if seen == last:
            break
        last = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

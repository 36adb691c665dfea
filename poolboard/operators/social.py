"""Friend edges: stored one way, read both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(edges: DataFrame, left: str, right: str) -> DataFrame:
    return edges.select(F.col(left).alias("viewer_id"), F.col(right).alias("friend_id"))


def mutual(edges: DataFrame) -> DataFrame:
    """Every edge seen from both ends; an edge both sides made shows twice."""
    return _pairs(edges, "user_id", "friend_id").union(_pairs(edges, "friend_id", "user_id"))


def friend_set(edges: DataFrame) -> DataFrame:
    """Everyone a viewer is connected with, whoever made the edge."""
    return mutual(edges).distinct()


def friend_add(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Edges after requests: one direction only, no repeats, nobody befriends themselves."""
    wanted = requests.where(F.col("user_id") != F.col("friend_id")).select("user_id", "friend_id")
    return edges.select("user_id", "friend_id").unionByName(wanted).distinct()


def friend_remove(edges: DataFrame, requests: DataFrame, both: bool = False) -> DataFrame:
    """Edges after removals. Only the asker's own edge goes; with ``both`` the reverse goes too."""
    gone = requests.select("user_id", "friend_id")
    if both:
        gone = gone.union(gone.select("friend_id", "user_id"))
    return edges.join(gone, ["user_id", "friend_id"], "left_anti")

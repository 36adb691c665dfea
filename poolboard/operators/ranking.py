"""Rankings, positions and movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.numbering import numbered, numbered_within
from .policy import visible_edges
from .scoring import pending_points
from .social import friend_set, mutual


def _by_points():
    return [F.col("total_points").desc(), F.col("username").asc()]


def ranking_rows(points: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Approved users and sets nobody owns, unordered. ``points`` holds users with total_points."""
    users = points.where("is_approved").select(
        F.col("user_id").cast("string").alias("user_id"), "username",
        F.col("total_points").cast("long").alias("total_points"), F.lit(False).alias("is_pending"))
    sets = pending_points(pending, fixtures).withColumn("is_pending", F.lit(True))
    return users.unionByName(sets)


def full_ranking(points: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    return ranking_rows(points, pending, fixtures).orderBy(*_by_points())


def ranking_positions(points: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The ranking with positions 1..n; equal points do not share one."""
    return numbered(ranking_rows(points, pending, fixtures), _by_points())


def ranking_fallback(points: DataFrame) -> DataFrame:
    """All users by points, approved or not."""
    return points.select("user_id", "username", "total_points", F.lit(False).alias("is_pending")).orderBy(
        *_by_points())


def ranking_annotated(positions: DataFrame, edges: DataFrame, viewer) -> DataFrame:
    """The numbered ranking as one viewer sees it."""
    own = friend_set(visible_edges(edges, viewer)).where(F.col("viewer_id") == viewer)
    friends = own.select(F.col("friend_id").cast("string").alias("user_id"), F.lit(True).alias("is_friend"))
    is_me = F.col("user_id") == str(viewer)
    return positions.join(friends, "user_id", "left").select(
        *positions.columns, is_me.alias("is_me"), F.coalesce("is_friend", F.lit(False)).alias("is_friend"),
        (~is_me & ~F.col("is_pending")).alias("can_befriend"))


def notify_ranking(points: DataFrame, *more: str) -> DataFrame:
    """Positions for notifications: every user, no pending sets."""
    return numbered(points.select("user_id", "username", "total_points", *more), _by_points())


def movement(points: DataFrame) -> DataFrame:
    """Positions by total_points and, as prev_position, by before_points; the second order reads the first one's rows."""
    now = notify_ranking(points, "before_points")
    order = [F.col("before_points").desc(), F.col("username").asc()]
    return numbered(now, order, "prev_position").drop("before_points")


def rank_movement(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The present ranking with each user's earlier position, direction and steps."""
    before = previous.select("user_id", F.col("position").alias("prev_position"))
    gain = F.col("prev_position") - F.col("position")
    movement = F.when(gain > 0, "up").when(gain < 0, "down").otherwise("none")
    return current.join(before, "user_id", "left").select(
        "user_id", "username", "position", "prev_position", movement.alias("movement"),
        F.coalesce(F.abs(gain), F.lit(0)).alias("steps"))


def friend_leaderboard(points: DataFrame, edges: DataFrame, users: DataFrame, viewers: DataFrame | None = None) -> DataFrame:
    """For every viewer (all ``users`` without a list): themselves and their friends by points, from 1."""
    own = (users if viewers is None else viewers).select(
        F.col("user_id").alias("viewer_id"), F.col("user_id").alias("friend_id"))
    both_ways = mutual(edges)
    if viewers is not None:
        both_ways = both_ways.join(own.select("viewer_id"), "viewer_id", "left_semi")
    seen = both_ways.union(own)
    board = seen.distinct().withColumnRenamed("friend_id", "user_id").join(
        points.select("user_id", "username", "total_points"), "user_id")
    return numbered_within(board, ["viewer_id"], _by_points()).select(
        "viewer_id", "user_id", "username", "total_points", "position")

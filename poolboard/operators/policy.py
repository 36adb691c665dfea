"""Who may see and change which rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admins(users: DataFrame) -> DataFrame:
    return users.where("is_admin").select("user_id")


def is_admin(users: DataFrame, user_id) -> bool:
    return not users.where(F.col("is_admin") & (F.col("user_id") == user_id)).isEmpty()


def require_admin(users: DataFrame, caller) -> None:
    if not is_admin(users, caller):
        raise PermissionError("administrators only")


def visible_picks(picks: DataFrame, viewer) -> DataFrame:
    """A viewer's own picks."""
    return picks.where(F.col("user_id") == viewer)


def visible_picks_for(picks: DataFrame, viewers: DataFrame) -> DataFrame:
    """Own picks of each of many viewers (``user_id``)."""
    return picks.join(viewers.select("user_id"), "user_id", "left_semi")


def visible_edges(edges: DataFrame, viewer) -> DataFrame:
    return edges.where((F.col("user_id") == viewer) | (F.col("friend_id") == viewer))


def _viewer_is_admin(users: DataFrame, viewer):
    return users.where(F.col("user_id") == viewer).agg(F.coalesce(F.bool_or("is_admin"), F.lit(False))).scalar()


def visible_subscriptions(subs: DataFrame, users: DataFrame, viewer) -> DataFrame:
    """A viewer's own subscriptions; all of them for an administrator."""
    return subs.where((F.col("user_id") == viewer) | _viewer_is_admin(users, viewer))


def admin_only(rows: DataFrame, users: DataFrame, viewer) -> DataFrame:
    """All rows for an administrator, none for anybody else."""
    return rows.where(_viewer_is_admin(users, viewer))


def public_rows(rows: DataFrame) -> DataFrame:
    """Users and matches are open to everyone signed in."""
    return rows


def write_gate(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Each wanted change (relation, operation, owner_id, writer_id) with whether its writer may make it."""
    own = F.col("owner_id") == F.col("writer_id")
    admin = F.coalesce("writer_admin", F.lit(False))
    relation, operation = F.col("relation"), F.col("operation")
    allowed = (
        F.when(relation == "predictions", (operation == "insert") & own)
        .when(relation.isin("friendships", "push_subscriptions"), operation.isin("insert", "delete") & own)
        .when(relation == "users", (operation == "update") & (own | admin))
        .when(relation == "matches", (operation == "update") & admin)
        .when(relation == "pending_predictions", admin)
        .otherwise(False)
    )
    who = admins(users).select(F.col("user_id").alias("writer_id"), F.lit(True).alias("writer_admin"))
    return changes.join(who, "writer_id", "left").select(*changes.columns, allowed.alias("allowed"))

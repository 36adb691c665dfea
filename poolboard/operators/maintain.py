"""Inserts, updates and deletes as DataFrame jobs: read, compute, write elsewhere, swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wording import OUTCOMES
from ..plans.spread import for_each


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, the first by ``order`` of equal keys: what an append has to write."""
    first = Window.partitionBy(*keys).orderBy(*order)
    one = incoming.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1)
    return one.join(existing.select(*keys), keys, "left_anti").select(*existing.columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after the insert: rows whose key exists are skipped."""
    return existing.unionByName(new_rows(existing, incoming, keys, order))


def upsert_update(existing: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Insert, or overwrite the ``update`` columns where the key exists, with nulls too.

    ``incoming`` holds each key once.
    """
    old = existing.withColumn("__old", F.lit(True)).alias("o")
    new = incoming.withColumn("__new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    inserted = F.col("__old").isNull()

    def value(column: str) -> Column:
        if column in keys:
            return F.coalesce(f"o.{column}", f"n.{column}")
        if column not in incoming.columns:
            return F.col(f"o.{column}")
        replaced = F.col("__new").isNotNull() if column in update else inserted
        return F.when(replaced, F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))

    return joined.select(*[value(c).alias(c) for c in existing.columns])


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` where ``source`` has the key; other rows keep what they have."""
    new = source.select(key, F.col(column).alias("__new"))
    return target.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).select(*target.columns)


def without(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose ``column`` is not among the ``key`` values that went."""
    return rows.join(gone.select(F.col(key).alias(column)), column, "left_anti").select(*rows.columns)


def set_null(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows with ``column`` emptied where it points to a value that went.

    Rows that point nowhere, often most of them, stay out of the join: as one null key
    they would all meet in one task.
    """
    marked = gone.select(F.col(key).alias(column)).distinct().withColumn("__gone", F.lit(True))
    kept = F.when(F.col("__gone").isNull(), F.col(column))
    pointing = rows.where(F.col(column).isNotNull()).join(marked, column, "left").withColumn(column, kept)
    return rows.where(F.col(column).isNull()).unionByName(pointing.select(*rows.columns))


def cascade_delete(relations: dict[str, DataFrame], users: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """What stays of picks, edges, subscriptions and pending after users and matches go."""
    picks = without(relations["picks"], users, "user_id", "user_id")
    edges = without(relations["edges"], users, "user_id", "user_id")
    pending = without(relations["pending"], matches, "match_id", "match_id")
    return {
        "picks": without(picks, matches, "match_id", "match_id"),
        "edges": without(edges, users, "friend_id", "user_id"),
        "subscriptions": without(relations["subscriptions"], users, "user_id", "user_id"),
        "pending": set_null(pending, users, "assigned_to", "user_id"),
    }


def synthetic_picks(users: DataFrame, fixtures: DataFrame, existing: DataFrame, draw: Column | None = None,
                    seed: int = 7) -> DataFrame:
    """A pick for every user and match of a contest that has none yet.

    ``draw`` is 0, 1 or 2 from the row's own columns; without it a seeded hash of the
    key, so a task that runs again draws the same.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "user_id", "match_id"), F.lit(3)) if draw is None else draw
    choice = F.get(F.array(*[F.lit(o) for o in OUTCOMES]), draw.cast("int"))
    missing = for_each(users.select("user_id"), fixtures, ["match_id"]).join(
        existing.select("user_id", "match_id"), ["user_id", "match_id"], "left_anti")
    return missing.select(
        "user_id", "match_id", choice.alias("predicted_result"))

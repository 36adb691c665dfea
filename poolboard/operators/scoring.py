"""Results, hits and points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import label_uuid
from ..functions.outcomes import derive_result as result_of
from ..functions.outcomes import is_hit
from ..functions.text import goals


def derive_result(fixtures: DataFrame) -> DataFrame:
    return fixtures.withColumn("actual_result", result_of())


def pick_hits(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Every pick with its match result and whether it scores."""
    outcome = fixtures.select("match_id", "match_order", "status", "actual_result")
    return picks.join(outcome, "match_id").select(
        "user_id", "match_id", "match_order", "predicted_result", "actual_result", is_hit().alias("hit"))


def winning_picks(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Only the picks that score: the result takes part in the join key, so misses end there."""
    won = fixtures.where((F.col("status") == "finished") & F.col("actual_result").isNotNull()).select(
        "match_id", F.col("actual_result").alias("predicted_result"))
    return picks.join(won, ["match_id", "predicted_result"])


def hits_per_user(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    return winning_picks(picks, fixtures).groupBy("user_id").agg(F.count("*").alias("total_points"))


def user_points(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Live points of every user, 0 for those without a hit."""
    return users.join(hits_per_user(picks, fixtures), "user_id", "left").select(
        *users.columns, F.coalesce("total_points", F.lit(0)).alias("total_points"))


def points_without(points: DataFrame, picks: DataFrame, fixtures: DataFrame, match_ids: list) -> DataFrame:
    """Totals and ``before_points``, those ahead of some matches: only the picks of those matches are read again."""
    these = F.col("match_id").isin(*match_ids)
    gained = hits_per_user(picks.where(these), fixtures.where(these)).withColumnRenamed("total_points", "gained")
    before = F.col("total_points") - F.coalesce("gained", F.lit(0))
    return points.join(gained, "user_id", "left").withColumn("before_points", before).drop("gained")


def points_of_pickers(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Live points of the users who have picks, zeros included."""
    return pick_hits(picks, fixtures).groupBy("user_id").agg(F.count_if("hit").alias("total_points"))


def pending_points(pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Live points of every set nobody owns yet; copies of a row count each time."""
    scored = pending.where(F.col("assigned_to").isNull()).join(
        fixtures.select("match_id", "status", "actual_result"), "match_id")
    totals = scored.groupBy("label").agg(F.count_if(is_hit()).alias("total_points"))
    return totals.select(label_uuid("label").alias("user_id"), F.col("label").alias("username"), "total_points")


def valid_edits(log: DataFrame) -> DataFrame:
    """Goal edits whose two numbers are whole and not negative."""
    typed = log.withColumn("home_goals", goals("home_goals")).withColumn("away_goals", goals("away_goals"))
    return typed.where(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())


def match_results_apply(fixtures: DataFrame, log: DataFrame) -> DataFrame:
    """Fixtures after a log of edits: the last edit sets goals and status.

    ``save`` leaves a match in progress and its earlier result alone; the last
    ``finish`` decides the result.
    """
    edits = valid_edits(log)
    moment = F.struct("ts", "event_id")
    edit = F.struct("action", "home_goals", "away_goals")
    last = edits.groupBy("match_id").agg(
        F.max_by(edit, moment).alias("edit"),
        F.max_by(edit, F.when(F.col("action") == "finish", moment)).alias("finish"))
    finished_result = result_of(F.lit("finished"), "finish.home_goals", "finish.away_goals",
                                F.lit(None).cast("string"))
    changed = F.col("edit").isNotNull()
    status = F.when(F.col("edit.action") == "finish", "finished").otherwise("in_progress")
    new = {
        "home_goals": F.when(changed, F.col("edit.home_goals")).otherwise(F.col("home_goals")),
        "away_goals": F.when(changed, F.col("edit.away_goals")).otherwise(F.col("away_goals")),
        "status": F.when(changed, status).otherwise(F.col("status")),
        "actual_result": F.when(F.col("finish").isNotNull(), finished_result).otherwise(F.col("actual_result")),
    }
    joined = fixtures.join(last, "match_id", "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in fixtures.columns])

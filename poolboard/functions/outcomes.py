"""Expressions on outcomes, hits and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col
from .wording import OUTCOME_WORDS


def derive_result(status="status", home="home_goals", away="away_goals", given="actual_result") -> Column:
    """Result of a finished match with both goals; any other match keeps the given one."""
    home, away, given = col(home), col(away), col(given)
    decided = F.when(home > away, "1").when(away > home, "2").otherwise("X")
    known = (col(status) == "finished") & home.isNotNull() & away.isNotNull()
    return F.when(known, decided).otherwise(given)


def is_hit(pick="predicted_result", result="actual_result", status="status") -> Column:
    """True only for a finished match with an equal result; a null result is a miss."""
    return F.coalesce((col(status) == "finished") & (col(pick) == col(result)), F.lit(False))


def votes_for(pick="predicted_result") -> Column:
    """The consensus count that belongs to a pick."""
    return F.when(col(pick) == "1", F.col("votes_1")).when(col(pick) == "X", F.col("votes_x")).otherwise(
        F.col("votes_2"))


def percent(votes: Column | str, total: Column | str) -> Column:
    """Whole-number share; null without votes. Divide before scaling: the other order rounds differently."""
    return F.when(col(total) > 0, F.round(col(votes) / col(total) * 100).cast("int"))


def outcome_word(pick: Column | str = "predicted_result") -> Column:
    """Home or draw by name; anything else, a missing pick too, reads as away."""
    return (F.when(col(pick) == "1", OUTCOME_WORDS["1"]).when(col(pick) == "X", OUTCOME_WORDS["X"])
            .otherwise(OUTCOME_WORDS["2"]))

"""Crowd votes and the statistics of each user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.outcomes import is_hit, percent, votes_for
from ..functions.wording import DISTRIBUTION_NAMES, OUTCOMES
from ..plans.numbering import numbered
from ..plans.spread import for_each

VOTES = {"1": "votes_1", "X": "votes_x", "2": "votes_2"}


def _votes(picks: DataFrame, key: str) -> DataFrame:
    pick = F.col("predicted_result")
    return picks.groupBy(key).agg(
        *[F.count_if(pick == o).alias(VOTES[o]) for o in OUTCOMES], F.count("*").alias("votes_total"))


def consensus(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Votes per match, zeros included. Counting first keeps the join one row per match."""
    counts = [*VOTES.values(), "votes_total"]
    return fixtures.select("match_id", "match_order").join(_votes(picks, "match_id"), "match_id", "left").select(
        "match_id", "match_order", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def consensus_percent(votes: DataFrame) -> DataFrame:
    return votes.select("*", *[percent(v, "votes_total").alias(v.replace("votes", "pct")) for v in VOTES.values()])


def _rated_picks(picks: DataFrame, votes: DataFrame) -> DataFrame:
    return picks.join(votes.where("votes_total > 0"), "match_id").select(
        "user_id", "match_id", "match_order", "predicted_result",
        votes_for().alias("votes"), F.col("votes_total").alias("total"))


def _five(picks: DataFrame, votes: DataFrame, share_order: Column, k: int) -> DataFrame:
    best = Window.partitionBy("user_id").orderBy(share_order, "match_order")
    rated = _rated_picks(picks, votes).withColumn("rank", F.row_number().over(best))
    return rated.where(F.col("rank") <= k)


def consensus_top(picks: DataFrame, votes: DataFrame, k: int = 5) -> DataFrame:
    """Per user the picks most people share; each group is cut to ``k`` before the shuffle."""
    return _five(picks, votes, (F.col("votes") / F.col("total")).desc(), k)


def consensus_bottom(picks: DataFrame, votes: DataFrame, k: int = 5) -> DataFrame:
    """Per user the picks fewest people share."""
    return _five(picks, votes, (F.col("votes") / F.col("total")).asc(), k)


def user_distribution(users: DataFrame, picks: DataFrame) -> DataFrame:
    """Three rows per user, home, draw, away, with count and whole-number share."""
    counted = users.select("user_id").join(_votes(picks, "user_id"), "user_id", "left")
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("slot"), F.lit(DISTRIBUTION_NAMES[o]).alias("name"),
                 F.coalesce(VOTES[o], F.lit(0)).alias("value"),
                 percent(VOTES[o], "votes_total").alias("pct"))
        for i, o in enumerate(OUTCOMES)])
    return counted.select("user_id", F.inline(rows))


def group_sides(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Fixtures with the groups of both teams, null where a team is unknown."""
    home = teams.select(F.col("team").alias("home_team"), F.col("team_id").alias("h_id"), F.col("grp").alias("home_grp"))
    away = teams.select(F.col("team").alias("away_team"), F.col("team_id").alias("a_id"), F.col("grp").alias("away_grp"))
    return fixtures.join(home, "home_team", "left").join(away, "away_team", "left")


def group_map_audit(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Fixtures the group tables leave out: teams of different or unknown groups."""
    same = F.coalesce(F.col("home_grp") == F.col("away_grp"), F.lit(False))
    return group_sides(fixtures, teams).where(~same).select(
        "match_id", "match_order", "home_team", "away_team", "home_grp", "away_grp")


def group_standings(users: DataFrame, picks: DataFrame, fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    """Group tables as each user's picks would have them, every team listed.

    Counts per user, match side and team combine before the shuffle; then every user meets every team.
    """
    inside = group_sides(fixtures, teams).where(F.col("home_grp") == F.col("away_grp")).select(
        "match_id", "h_id", "a_id")
    pick = F.col("predicted_result")
    sides = F.array(
        F.struct(F.col("h_id").alias("team_id"), (pick == "1").alias("won"), (pick == "2").alias("lost")),
        F.struct(F.col("a_id").alias("team_id"), (pick == "2").alias("won"), (pick == "1").alias("lost")))
    per_team = (picks.join(inside, "match_id").select("user_id", F.inline(sides))
                .groupBy("user_id", "team_id").agg(
                    F.count("*").alias("played"), F.count_if("won").alias("won"), F.count_if("lost").alias("lost")))
    played, won, lost = (F.coalesce(c, F.lit(0)) for c in ("played", "won", "lost"))
    drawn = F.col("played") - F.col("won") - F.col("lost")
    full = (for_each(users.select("user_id"), teams, ["team_id", "team", "grp"])
            .join(per_team, ["user_id", "team_id"], "left")
            .select("user_id", "grp", "team_id", "team", played.alias("played"), won.alias("won"), lost.alias("lost"))
            .withColumn("drawn", drawn).withColumn("points", F.col("won") * 3 + F.col("drawn")))
    table = Window.partitionBy("user_id", "grp").orderBy(F.desc("points"), F.desc("won"), "team_id")
    return full.withColumn("rank", F.row_number().over(table)).select(
        "user_id", "grp", "rank", "team", "played", "won", "drawn", "lost", "points")


def _hit_places(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Hits by place among the finished matches; what is missing between places breaks a run."""
    finished = fixtures.where(F.col("status") == "finished").select(
        "match_id", "match_order", "status", "actual_result")
    places = numbered(finished, [F.col("match_order")], "place")
    return picks.join(places, "match_id").where(is_hit()).select("user_id", "place")


def _runs(hits: DataFrame) -> DataFrame:
    ordered = Window.partitionBy("user_id").orderBy("place")
    return hits.withColumn("island", F.col("place") - F.row_number().over(ordered)).groupBy("user_id", "island").agg(
        F.count("*").alias("length"), F.max("place").alias("last"))


def streaks(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Best run and the run that reaches the latest finished match, for all users at once."""
    finished = fixtures.where(F.col("status") == "finished").agg(F.count("*")).scalar()
    runs = _runs(_hit_places(picks, fixtures)).groupBy("user_id").agg(
        F.max("length").alias("best"), F.max(F.when(F.col("last") == finished, F.col("length"))).alias("current"))
    return users.select("user_id").join(runs, "user_id", "left").select(
        "user_id", F.coalesce("best", F.lit(0)).alias("best_streak"),
        F.coalesce("current", F.lit(0)).alias("current_streak"))


def streak_best(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    return streaks(users, picks, fixtures).select("user_id", "best_streak")


def streak_current(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    return streaks(users, picks, fixtures).select("user_id", "current_streak")

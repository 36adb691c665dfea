"""Lists, grids, progress and digests of picks, for any number of fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import label_uuid
from ..functions.outcomes import outcome_word
from ..functions.text import display_name, first_word
from ..functions.wording import CONTEST_SIZE, OUTCOME_LETTERS, OUTCOMES
from ..plans.numbering import numbered
from ..plans.spread import for_each
from .policy import require_admin


def _shown_id() -> Column:
    """The id of a row of the pick list: the user's, or the one a set's label stands for."""
    return F.coalesce("user_id", label_uuid("username")).alias("user_id")


def _pick_rows(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Picks of users and of sets nobody owns; sets have no user_id yet.

    ``row_id`` is the ``id`` of pending rows, where they have one: those may repeat, and
    it lets a sort split them.
    """
    row_id = F.col("id") if "id" in pending.columns else F.lit(None)
    own = picks.join(users.select("user_id", "username"), "user_id").select(
        F.col("user_id").cast("string").alias("user_id"), "username", "match_id", "predicted_result",
        F.lit(None).cast("long").alias("row_id"))
    sets = pending.where(F.col("assigned_to").isNull()).select(
        F.lit(None).cast("string").alias("user_id"), F.col("label").alias("username"), "match_id",
        "predicted_result", row_id.cast("long").alias("row_id"))
    return own.unionByName(sets).join(fixtures.select("match_id", "match_order"), "match_id")


def all_picks(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Picks of users and of sets nobody owns, in one list ordered for display."""
    rows = _pick_rows(picks, users, pending, fixtures).orderBy("username", "match_order", "row_id")
    return rows.select(_shown_id(), "username", "match_id", "match_order", "predicted_result")


def match_picks(picks: DataFrame, users: DataFrame, match_id, caller) -> DataFrame:
    """Who picked what for one match; administrators only."""
    require_admin(users, caller)
    return picks.where(F.col("match_id") == match_id).join(users.select("user_id", "username"), "user_id").select(
        "user_id", "username", "predicted_result").orderBy("username")


def my_picks(picks: DataFrame, user_id) -> DataFrame:
    return picks.where(F.col("user_id") == user_id).select("match_id", "predicted_result")


def _coded_rows(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("predicted_result"))
    return _pick_rows(picks, users, pending, fixtures).select(
        "user_id", "username", "match_order", code.cast("int").alias("code"))


def pick_matrix(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame,
                orders: list[int] | None = None) -> DataFrame:
    """Users by match order, letters or blank. Keyed by user id, so equal names stay apart.

    A column per order: the given ones, else a contest's 72 and every further one that occurs. Spark refuses more
    than ``spark.sql.pivotMaxValues`` columns; ``pick_map`` has no such bound.
    """
    coded = _coded_rows(picks, users, pending, fixtures)
    if orders is None:
        most = int(picks.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = coded.select("match_order").distinct().limit(most + 1).collect()
        orders = sorted({r.match_order for r in found} | set(range(1, CONTEST_SIZE + 1)))
        if len(orders) > most:
            raise ValueError(f"more than {most} columns; use pick_map")
    grid = coded.groupBy("user_id", "username").pivot("match_order", orders).agg(F.max("code"))
    letters = ", ".join(f"'{OUTCOME_LETTERS[o]}'" for o in OUTCOMES)
    cells = [f"elt(coalesce(`{o}`, 0) + 1, '', {letters}) as p{o}" for o in orders]
    shown = grid.withColumn("user_id", _shown_id())
    return shown.selectExpr("user_id", "username", *cells).orderBy("username")


def pick_map(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The matrix as a row per filled cell, for any number of fixtures: user_id, username, match_order, letter."""
    letters = F.array(*[F.lit(OUTCOME_LETTERS[o]) for o in OUTCOMES])
    cells = _coded_rows(picks, users, pending, fixtures).groupBy("user_id", "username", "match_order").agg(
        F.max("code").alias("code"))
    return cells.select(_shown_id(), "username", "match_order", F.get(letters, F.col("code") - 1).alias("letter"))


def last_finished(fixtures: DataFrame) -> DataFrame:
    return fixtures.where(F.col("status") == "finished").agg(F.max("match_order").alias("match_order"))


def pick_counts(picks: DataFrame, users: DataFrame, pending: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Number of rows of the pick list per id."""
    counts = _pick_rows(picks, users, pending, fixtures).groupBy("user_id", "username").agg(
        F.count("*").alias("picks"))
    return counts.select(_shown_id(), "picks")


def pick_completeness(users: DataFrame, picks: DataFrame, size: int = CONTEST_SIZE) -> DataFrame:
    done = F.coalesce("picks", F.lit(0))
    made = picks.groupBy("user_id").agg(F.count("*").alias("picks"))
    return users.join(made, "user_id", "left").select(
        "user_id", "username", done.alias("picks"),
        F.concat(done, F.lit(f"/{size}")).alias("progress"), (done == size).alias("complete"))


def _ranked(fixtures: DataFrame) -> DataFrame:
    """Fixtures with their rank by match order, from 1."""
    return numbered(fixtures, [F.col("match_order")], "rank")


def _next_ranks(users: DataFrame, picks: DataFrame, ranked: DataFrame) -> DataFrame:
    """Users with the rank of their first match without a pick: the first gap in their picked ranks, or one more."""
    made = picks.join(ranked.select("match_id", "rank"), "match_id").select("user_id", "rank").distinct()
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("rank"))
    gaps = made.withColumn("n", nth).groupBy("user_id").agg(
        F.min(F.when(F.col("rank") > F.col("n"), F.col("n"))).alias("gap"), F.count("*").alias("made"))
    after = F.coalesce(F.col("gap").cast("long"), F.coalesce("made", F.lit(0)) + 1)
    return users.join(gaps, "user_id", "left").select(*users.columns, after.alias("rank"))


def next_open_match(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The first match order without a pick; null when all are picked."""
    ranked = _ranked(fixtures)
    orders = ranked.select("rank", F.col("match_order").alias("next_order"))
    found = _next_ranks(users.select("user_id", "username"), picks, ranked).join(orders, "rank", "left")
    return found.select("user_id", "username", "next_order")


def pick_card_state(users: DataFrame, picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Every card of every user: locked, enabled (the next one) or disabled."""
    ranked = _ranked(fixtures)
    cards = for_each(_next_ranks(users.select("user_id"), picks, ranked).withColumnRenamed("rank", "next_rank"),
                     ranked, ["rank", "match_id", "match_order", "home_team", "away_team"], counted=users)
    made = picks.select("user_id", "match_id", F.col("predicted_result").alias("picked"))
    status = F.when(F.col("picked").isNotNull(), "locked").when(F.col("rank") == F.col("next_rank"), "enabled")
    return cards.join(made, ["user_id", "match_id"], "left").select(
        "user_id", "match_order", first_word("home_team").alias("home_short"),
        first_word("away_team").alias("away_short"), "picked", status.otherwise("disabled").alias("state"))


def picks_digest(users: DataFrame, picks: DataFrame, fixtures: DataFrame, size: int = CONTEST_SIZE) -> DataFrame:
    """A line per match for each user with a full card, with whom to send it to; to be read by match order."""
    full = picks.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") == size).select("user_id")
    people = users.join(full, "user_id").select(
        "user_id", "username", F.col("email").alias("mail_to"), display_name("nombre", "username").alias("display_name"))
    matches = fixtures.select("match_id", "match_order", "home_team", "away_team", "match_date")
    return picks.join(people, "user_id").join(matches, "match_id").select(
        "user_id", "username", "mail_to", "display_name", "match_order", "home_team", "away_team", "match_date",
        outcome_word("predicted_result").alias("pick"))

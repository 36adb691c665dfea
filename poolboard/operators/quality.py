"""Table rules as audits: each returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wording import CONTEST_SIZE, OUTCOMES, STATUSES, WEEKDAYS
from ..plans.numbering import numbered


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys])


def domain_violations(relation: str, df: DataFrame, keys: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows outside a rule (name -> column shown, condition); one pass, a null value passes."""
    broken = [F.when(~condition, F.struct(F.lit(rule).alias("rule"), F.col(column).cast("string").alias("value")))
              for rule, (column, condition) in rules.items()]
    found = F.filter(F.array(*broken), lambda v: v.isNotNull())
    return df.select(F.lit(relation).alias("relation"), _key(keys).alias("key"), F.inline(found))


def check_domain(picks: DataFrame, fixtures: DataFrame, pending: DataFrame, edges: DataFrame) -> DataFrame:
    pick = {"outcome": ("predicted_result", F.col("predicted_result").isin(*OUTCOMES))}
    match = {
        "match_order": ("match_order", F.col("match_order").between(1, CONTEST_SIZE)),
        "outcome": ("actual_result", F.col("actual_result").isin(*OUTCOMES)),
        "status": ("status", F.col("status").isin(*STATUSES)),
    }
    edge = {"self_friend": ("friend_id", F.col("user_id") != F.col("friend_id"))}
    return union_all([
        domain_violations("predictions", picks, ["user_id", "match_id"], pick),
        domain_violations("matches", fixtures, ["match_id"], match),
        domain_violations("pending_predictions", pending, ["label", "match_id"], pick),
        domain_violations("friendships", edges, ["user_id", "friend_id"], edge),
    ])


def check_not_null(relation: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per required column, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.lit(relation).alias("relation"), F.inline(rows))


def check_unique(relation: str, df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").select(
        F.lit(relation).alias("relation"), F.lit(",".join(keys)).alias("rule"), _key(keys).alias("key"), "copies")


def check_foreign_key(relation: str, child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values that point nowhere, with the number of rows they have. Counting first keeps the join small."""
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return used.join(parent.select(F.col(key).alias("value")), "value", "left_anti").select(
        F.lit(relation).alias("relation"), F.lit(column).alias("column_name"),
        F.col("value").cast("string").alias("missing"), F.col("n").alias("rows"))


def _with_order(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    return picks.join(fixtures.select("match_id", "match_order"), "match_id", "left")


def _lower_picks():
    return Window.partitionBy("user_id").orderBy("match_order").rowsBetween(Window.unboundedPreceding, -1)


def _broken(counted: DataFrame, out_of_sequence: Column) -> DataFrame:
    order = F.col("match_order")
    problem = F.when(order.isNull(), "unknown_match").when((order > 1) & out_of_sequence, "out_of_sequence")
    return counted.withColumn("problem", problem).where("problem is not null")


def check_sequence(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Picks at order N while the user holds fewer than N-1 lower ones (a contest has at most 72)."""
    counted = _with_order(picks, fixtures).withColumn("lower", F.count("match_order").over(_lower_picks()))
    return _broken(counted, F.col("lower") < F.col("match_order") - 1).select(
        "user_id", "match_id", "match_order", "lower", "problem")


def check_sequence_replay(picks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """The same rule at the moment each pick was made: a lower one that is missing or came later breaks it.

    Picks made at the same time count as made by match order.
    """
    known_at = F.when(F.col("match_order").isNotNull(), F.col("created_at"))
    counted = (_with_order(picks, fixtures).withColumn("lower", F.count("match_order").over(_lower_picks()))
               .withColumn("complete_at", F.max(known_at).over(_lower_picks())))
    late = (F.col("lower") < F.col("match_order") - 1) | (F.col("complete_at") > F.col("created_at"))
    return _broken(counted, late).select("user_id", "match_id", "match_order", "problem")


def check_immutable(before: DataFrame, after: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose value differs between two snapshots."""
    old = before.select(*keys, F.col(column).alias("old_value"))
    new = after.select(*keys, F.col(column).alias("new_value"))
    return old.join(new, keys).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def check_fixture_calendar(fixtures: DataFrame) -> DataFrame:
    """Matches whose weekday does not fit the date, or that start before the match listed ahead of them."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    right_day = F.get(names, F.dayofweek("match_date") - 1)
    kickoff = F.concat_ws(" ", F.col("match_date").cast("string"), "match_time")
    rows = numbered(fixtures.select("match_id", "match_order", "match_day", right_day.alias("right_day"),
                                    kickoff.alias("kickoff")), [F.col("match_order")], "n")
    ahead = rows.select((F.col("n") + 1).alias("n"), F.col("kickoff").alias("ahead"))
    problems = F.array(
        F.when(F.col("match_day") != F.col("right_day"), F.struct(
            F.lit("weekday").alias("problem"), F.col("match_day").alias("found"), F.col("right_day").alias("expected"))),
        F.when(F.col("kickoff") < F.col("ahead"), F.struct(
            F.lit("kickoff_order").alias("problem"), F.col("kickoff").alias("found"), F.col("ahead").alias("expected"))))
    return rows.join(ahead, "n", "left").select(
        "match_id", "match_order", F.inline(F.filter(problems, lambda p: p.isNotNull())))

"""Every registered query against its SQL, and facts that hold whatever the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check
import contest as c
from poolboard.plans import catalog, oracles


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, small_dir, name):
    assert check.compare(spark, small_dir, name).startswith("ok ")


def test_entry_is_a_numbered_ranking(spark):
    got = contract.entry(spark)
    assert got.columns == ["user_id", "username", "total_points", "is_pending", "position"]
    positions = sorted(r.position for r in got.collect())
    assert positions == list(range(1, len(positions) + 1))


def test_no_query_pairs_rows_without_a_key(spark, small_dir):
    cheap = [n for n in catalog.queries() if not n.startswith("stream_")]
    for name in cheap:
        plan = contract.queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_votes_equal_picks(spark, small_dir):
    q = contract.queries()
    votes = q["consensus"](spark, small_dir).agg(F.sum("votes_total")).first()[0]
    assert votes == q["pick_hits"](spark, small_dir).count()


def test_standings_play_every_inside_pick_twice(spark, small_dir):
    q = contract.queries()
    played = q["group_standings"](spark, small_dir).agg(F.sum("played")).first()[0]
    outside = q["group_map_audit"](spark, small_dir).select("match_id")
    inside = q["pick_hits"](spark, small_dir).join(outside, "match_id", "left_anti").count()
    assert played == 2 * inside


def test_best_run_is_at_least_the_current_one(spark, small_dir):
    q = contract.queries()
    both = q["streak_best"](spark, small_dir).join(q["streak_current"](spark, small_dir), "user_id")
    assert both.where("best_streak < current_streak").count() == 0
    assert c.rows(both.agg(F.count("*"))) == [(10,)]

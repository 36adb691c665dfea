"""Numbering, products, sources and the shape of physical plans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import contest as c
from poolboard.operators import fixtures, maintain, picks, ranking, scoring, stats
from poolboard.plans.numbering import numbered, numbered_within
from poolboard.plans.spread import for_each
from poolboard.sources.groups import GROUPS, team_groups
from poolboard.sources.projections import Relations
from poolboard.sources.tables import read_relation, write_relation


@pytest.fixture(scope="module")
def scores(spark):
    draw = random.Random(3)
    rows = [(0 if i % 3 else i, f"name{i:05d}", draw.randrange(4)) for i in range(4000)]
    return spark.createDataFrame(rows, "board long, username string, total_points long").repartition(7).cache()



def test_numbered_equals_a_global_window(spark, scores):
    order = [F.col("total_points").desc(), F.col("username")]
    plain = scores.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert c.rows(numbered(scores, order)) == c.rows(plain)


def test_rows_come_back_in_order(spark, scores):
    got = [r.position for r in numbered(scores, [F.col("total_points").desc(), F.col("username")]).collect()]
    assert got == list(range(1, 4001))


def test_nothing_to_number(spark, scores):
    assert numbered(scores.where("false"), [F.col("username")]).count() == 0
    assert numbered_within(scores.where("false"), ["board"], [F.col("username")]).count() == 0


def test_groups_of_any_size_are_numbered_across_tasks(spark, scores):
    order = [F.col("total_points").desc(), F.col("username")]
    plain = scores.withColumn("position", F.row_number().over(Window.partitionBy("board").orderBy(*order)).cast("long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = numbered_within(scores, ["board"], order)
        parts = spread.select("board", F.spark_partition_id().alias("p")).distinct().count()
        assert c.rows(spread) == c.rows(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_leaderboard_with_a_very_connected_viewer(spark):
    names = [f"u{i:03d}" for i in range(200)]
    who = c.people(spark, *names)
    chosen = c.picks(spark, {i: "1" if i % 2 else "X" for i in range(1, 201)})
    table = scoring.user_points(who, chosen, c.finished(spark, "1"))
    edges = spark.createDataFrame([(i, 1) for i in range(2, 201)] + [(1, 2)], "user_id long, friend_id long")
    plain = ranking.friend_leaderboard(table, edges, who)
    hub = plain.where("viewer_id = 1").orderBy("position").collect()
    assert [r.position for r in hub] == list(range(1, 201))
    assert [r.username for r in hub] == sorted(names, key=lambda n: (int(n[1:]) % 2, n))
    only = ranking.friend_leaderboard(table, edges, who, viewers=who.where("user_id = 2"))
    assert c.rows(only, "viewer_id", "user_id", "position") == [(2, 1, 1), (2, 2, 2)]


def test_every_row_meets_every_other_one(spark):
    who, matches = c.people(spark, *[f"u{i}" for i in range(90)]), c.finished(spark, "1X2" * 30)
    got = for_each(who.select("user_id"), matches, ["match_order"])
    assert c.rows(got) == sorted(((u, m) for u in range(1, 91) for m in range(1, 91)), key=repr)


def test_contests_of_two_thousand_fixtures(spark):
    """What used to stop at a thousand fixtures."""
    size = 2000
    matches = c.finished(spark, "1" * size)
    who = c.people(spark, "ana", "bea", "cai")
    chosen = c.picks(spark, {1: "1" * size, 2: "1" * 1200 + "-" + "1" * 799})
    assert c.by(picks.next_open_match(who, chosen, matches), "user_id", "next_order") == {1: None, 2: 1201, 3: 1}
    assert c.rows(stats.streaks(who, chosen, matches)) == [(1, 2000, 2000), (2, 1200, 799), (3, 0, 0)]
    assert maintain.synthetic_picks(who, matches, chosen).count() == 1 + size
    cards = picks.pick_card_state(who, chosen, matches).groupBy("user_id", "state").count()
    assert c.rows(cards) == [(1, "locked", 2000), (2, "enabled", 1), (2, "locked", 1999),
                             (3, "disabled", 1999), (3, "enabled", 1)]
    assert picks.picks_digest(who, chosen, matches, size=size).count() == size
    none = c.pending(spark)
    assert picks.pick_map(chosen, who, none, matches).count() == 2 * size - 1
    grid = picks.pick_matrix(chosen, who, none, matches.where("match_order in (72, 73, 2000)"))
    assert grid.columns[-2:] == ["p73", "p2000"] and c.rows(grid, "p72", "p73", "p2000") == [("L", "L", "L")] * 2


def test_group_map_has_twelve_groups_of_four(spark):
    teams = team_groups(spark)
    assert teams.count() == 48 and teams.select("team").distinct().count() == 48
    assert [len(t) for t in GROUPS.values()] == [4] * 12


def test_group_tables_from_picks_only(spark):
    teams = team_groups(spark)
    pairs = [("MEXICO", "SUDAFRICA"), ("COREA", "REP. CHECA"), ("SUDAFRICA", "COREA"), ("MEXICO", "QATAR"),
             ("MEXICO", "ATLANTIS")]
    matches = spark.createDataFrame([(i * 10, i, h, a) for i, (h, a) in enumerate(pairs, 1)],
                                    "match_id long, match_order long, home_team string, away_team string")
    got = stats.group_standings(c.people(spark, "ana", "bea"), c.picks(spark, {1: "1X211"}), matches, teams)
    ana = c.rows(got.where("user_id = 1 and grp = 'A'"), "rank", "team", "played", "won", "drawn", "lost", "points")
    assert ana == [(1, "COREA", 2, 1, 1, 0, 4), (2, "MEXICO", 1, 1, 0, 0, 3), (3, "REP. CHECA", 1, 0, 1, 0, 1),
                   (4, "SUDAFRICA", 2, 0, 0, 2, 0)]
    assert got.count() == 96 and got.where("user_id = 2").agg(F.sum("played")).first()[0] == 0
    dropped = stats.group_map_audit(matches, teams)
    assert c.rows(dropped, "match_order", "home_grp", "away_grp") == [(4, "A", "C"), (5, "A", None)]


def test_fixture_text_round_trip(spark, tmp_path):
    lines = ["| Partido | Local | Visitante | Fecha | Hora | Día |", "| :--- | :--- | :--- | :--- | :--- | :--- |",
             "| 1 | MEXICO | SUDAFRICA | 11/06/26 | 16:00:00 | Jueves |", "some text",
             "| 2 | COREA | REP. CHECA | 11/06/26 | 23:00:00 | Jueves |"]
    path = tmp_path / "fixture.md"
    path.write_text("\n".join(lines), encoding="utf-8")
    got = fixtures.fixture_text_load(spark, str(path))
    assert [(r.match_order, r.home_team, r.away_team, str(r.match_date), r.match_day) for r in got.collect()] == [
        (1, "MEXICO", "SUDAFRICA", "2026-06-11", "Jueves"), (2, "COREA", "REP. CHECA", "2026-06-11", "Jueves")]


@pytest.mark.parametrize("file_format,options", [("parquet", {}), ("json", {}), ("csv", {"header": True}), ("orc", {})])
def test_relations_survive_every_format(spark, file_format, options):
    rows = [("u1", 1, "X", None), ("u2", 2, "1", None)]
    df = spark.createDataFrame(rows, "user_id string, match_id long, predicted_result string, created_at timestamp")
    path = write_relation(df, "predictions", file_format=file_format, **options)
    assert c.rows(read_relation(spark, "predictions", path, file_format, **options)) == c.rows(df)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_trimmed_before_the_shuffle(spark, small_dir):
    shown = plan(Relations(spark, small_dir).picks())
    assert shown.index("Final") < shown.index("Exchange") < shown.index("Partial")


def test_top_five_is_trimmed_before_the_shuffle(spark, small_dir):
    r = Relations(spark, small_dir)
    shown = plan(stats.consensus_top(r.picks(), stats.consensus(r.picks(), r.fixtures())))
    assert "row_number(), 5, Partial" in shown


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    r = Relations(spark, small_dir)
    mine = plan(picks.my_picks(r.picks(), 8))
    assert "EqualTo(o_custkey,8)" in mine and "EqualTo(l_linestatus,F)" in mine
    assert "l_extendedprice" not in mine and "o_totalprice" not in mine

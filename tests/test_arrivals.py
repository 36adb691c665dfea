"""Logs as streams of row ranges, picks and edits that both arrive, and how evenly work is spread."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import contest as c
from poolboard.operators import order_statistics, outbox, ranking, scoring
from poolboard.plans.spread import for_each, grid
from poolboard.sources.arrivals import RowRangeReader, let_arrive, read_log, write_log
from poolboard.streaming.logs import run_to_end
from poolboard.streaming.picks import PickLog, both_arrive
from poolboard.streaming.points import FinishOutboxJob, PointsJob, stream_points

EDITS = "event_id long, match_id long, ts timestamp, action string, home_goals string, away_goals string"
PICKS = "user_id long, match_id long, predicted_result string"


@pytest.fixture
def seen(spark, tmp_path):
    """Runs a stream and returns (batch, partitions with rows, ids) of each of its batches."""
    def run(stream, root, arriving=None):
        found = []

        def on_batch(batch, number):
            rows = batch.select("id", F.spark_partition_id().alias("part")).collect()
            found.append((number, len({r.part for r in rows}), [r.id for r in rows]))
        run_to_end(stream, on_batch, str(tmp_path / root), arriving=arriving)
        return found
    return run


def test_a_log_arrives_in_ranges_read_by_several_tasks(spark, seen, tmp_path):
    rows = spark.range(60_000).select(F.col("id"), (F.lit(60_000) - F.col("id")).alias("at"), F.lit("x").alias("unread"))
    path = str(tmp_path / "log")
    write_log(rows.repartition(5), path, ["at"])
    stream = read_log(spark, path, rows.select("id").schema)
    batches = seen(stream, "three", let_arrive(path, 3))
    assert [n for n, _, _ in batches] == [0, 1, 2] and all(tasks > 1 for _, tasks, _ in batches)
    assert [len(ids) for _, _, ids in batches] == [20_000] * 3
    assert sorted(i for _, _, ids in batches for i in ids) == list(range(60_000))  # each row in one batch
    assert min(batches[0][2]) > max(batches[1][2]) > min(batches[1][2]) > max(batches[2][2])  # in order of arrival


def test_a_restarted_reader_goes_on_behind_the_last_row(spark, seen, tmp_path):
    rows, path = spark.range(10).select("id", F.col("id").alias("at")), str(tmp_path / "log")
    write_log(rows.where("at < 4"), f"{path}/1", ["at"])
    assert [sorted(ids) for _, _, ids in seen(read_log(spark, path, rows.schema), "root")] == [[0, 1, 2, 3]]
    write_log(rows.where("at >= 4"), f"{path}/2", ["at"])
    assert [(n, sorted(ids)) for n, _, ids in seen(read_log(spark, path, rows.schema), "root")] == [(1, [4, 5, 6, 7, 8, 9])]
    assert seen(read_log(spark, path, rows.schema), "root") == []


def test_ranges_cover_each_row_once_whatever_the_files(spark, tmp_path):
    path = str(tmp_path / "log")
    for n, size in enumerate((7_000, 1, 0, 25_000)):
        spark.range(size).coalesce(1).write.option("parquet.block.size", 20_000).parquet(f"{path}/{n}")
    reader = RowRangeReader(spark.range(1).schema, {"path": path, "tasks": "3"})
    assert reader.latestOffset() == {"row": 32_001}
    for start, end in ((0, 32_001), (6_999, 7_002), (100, 100), (5_000, 32_000)):
        read = sum(batch.num_rows for part in reader.partitions({"row": start}, {"row": end}) for batch in reader.read(part))
        assert read == end - start


def test_values_and_nulls_come_through(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, datetime(2026, 6, 11, 10, 0, 0, 123456), "é", 1.5), (2, None, None, None)],
        "id long, ts timestamp, name string, share double")
    write_log(rows, str(tmp_path / "log"), ["id"])
    found = []
    run_to_end(read_log(spark, str(tmp_path / "log"), rows.schema), lambda b, n: found.extend(b.collect()), str(tmp_path / "root"))
    assert sorted(found) == sorted(rows.collect())


@pytest.fixture(scope="module")
def game(spark):
    matches = c.fixtures(spark, (1, "finished", 1, 0, "1"), *[(i, "pending", None, None, None) for i in range(2, 7)])
    people = c.people(spark, *[f"u{i}" for i in range(12)])
    start = datetime(2026, 6, 11)
    edits = [(i, (i * 7 % 6 + 1) * 10, start + timedelta(minutes=i), "finish" if i % 3 else "save", str(i * 3 % 4),
              "x" if i % 11 == 0 else str(i % 3)) for i in range(36)]
    picks = [(1 + n % 12, (n // 12 + 1) * 10, "1X2"[n * n % 3]) for n in range(72)]
    return people, matches, edits, picks


def test_picks_that_arrive_between_results_count_at_the_next_finish(spark, game):
    """After every cut of both: what one batch over all that was there at the last finish gives."""
    people, matches, edits, picks = game
    late = spark.createDataFrame(picks, PICKS)
    job = PointsJob(late.limit(0), matches)
    job.start = None
    cuts = [(0, 10), (0, 25), (9, 25), (9, 30), (20, 40), (21, 60), (21, 72), (36, 72)]  # edits and picks there by then
    done = counted = edits_before = picks_before = 0
    for number, (n_edits, n_picks) in enumerate(cuts):
        stream = both_arrive(spark.createDataFrame(edits[edits_before:n_edits], EDITS),
                             spark.createDataFrame(picks[picks_before:n_picks], PICKS))
        job.on_batch(stream, number)
        finishes = [e[0] for e in edits[edits_before:n_edits] if e[3] == "finish" and e[5] != "x"]
        if finishes:
            done, counted = max(finishes) + 1, n_picks
        edits_before, picks_before = n_edits, n_picks
        now = scoring.match_results_apply(matches, spark.createDataFrame(edits[:done], EDITS))
        if not done:
            assert set(c.by(job.totals(people), "user_id", "total_points").values()) == {0}
            continue
        wanted = scoring.user_points(people, spark.createDataFrame(picks[:counted], PICKS), now)
        assert c.rows(job.totals(people)) == c.rows(wanted, "user_id", "username", "total_points"), number
        live = scoring.user_points(people, spark.createDataFrame(picks[:n_picks], PICKS), now)
        assert c.rows(job.totals(people, live=True)) == c.rows(live, "user_id", "username", "total_points"), number
    before = c.rows(job.totals(people))
    job.on_batch(stream, number)  # a repeated batch replaces itself
    assert c.rows(job.totals(people)) == before


def test_two_growing_streams_in_one_job_and_a_restart(spark, game, tmp_path):
    people, matches, edits, picks = game
    both = {"edits": spark.createDataFrame(edits, EDITS), "picks": spark.createDataFrame(picks, PICKS)}
    paths = {name: str(tmp_path / name) for name in both}

    def streams():
        edits, picks = (read_log(spark, paths[n], both[n].schema) for n in both)
        return both_arrive(edits, picks), picks
    write_log(both["edits"].where("event_id < 20"), f"{paths['edits']}/1", ["ts", "event_id"])
    write_log(both["picks"].where("match_id < 40"), f"{paths['picks']}/1", ["match_id"])
    arrivals, chosen = streams()
    root = str(tmp_path / "root")
    first = stream_points(arrivals, people, chosen, matches, root)
    now = scoring.match_results_apply(matches, both["edits"].where("event_id < 20"))
    wanted = scoring.user_points(people, both["picks"].where("match_id < 40"), now)
    assert c.rows(first) == c.rows(wanted, "user_id", "username", "total_points")
    write_log(both["picks"].where("match_id >= 40"), f"{paths['picks']}/2", ["match_id"])
    assert c.rows(stream_points(streams()[0], people, chosen, matches, root)) == c.rows(first)  # no finish yet
    write_log(both["edits"].where("event_id >= 20"), f"{paths['edits']}/2", ["ts", "event_id"])
    last = max(e[0] for e in edits if e[3] == "finish" and e[5] != "x")
    now = scoring.match_results_apply(matches, both["edits"].where(F.col("event_id") <= last))
    wanted = scoring.user_points(people, both["picks"], now)
    assert c.rows(stream_points(streams()[0], people, chosen, matches, root)) == c.rows(wanted, "user_id", "username", "total_points")


def test_picks_arrive_while_messages_are_written(spark, game):
    """Picks ahead of the edits of their batch, one edit at a time as the rule."""
    people, matches, edits, picks = game
    subs = spark.createDataFrame([(1, 1, "e"), (2, 9, "e"), (3, 99, "e")], "sub_id long, user_id long, endpoint string")
    job = FinishOutboxJob(people, spark.createDataFrame(picks[:0], PICKS), matches, subs)
    job.start = None
    wanted, state = [], {r.match_id: r.status == "finished" for r in matches.collect()}
    for number, (a, b, n_picks) in enumerate([(0, 12, 30), (12, 24, 72), (24, 36, 72)]):
        before = 0 if not number else [30, 72, 72][number - 1]
        job.on_batch(both_arrive(spark.createDataFrame(edits[a:b], EDITS), spark.createDataFrame(picks[before:n_picks], PICKS)), number)
        chosen = spark.createDataFrame(picks[:n_picks], PICKS)
        for e in edits[a:b]:
            if e[5] == "x":
                continue
            if e[3] == "finish" and not state[e[1]]:
                after = scoring.match_results_apply(matches, spark.createDataFrame(edits[:e[0] + 1], EDITS))
                table = ranking.notify_ranking(scoring.user_points(people, chosen, after)).withColumn(
                    "prev_position", F.lit(None).cast("long"))
                sent = outbox.finish_outbox(after.where(F.col("match_id") == e[1]), subs, chosen, table)
                wanted += [(e[0], *r) for r in c.rows(sent)]
            state[e[1]] = e[3] == "finish"
    assert len(wanted) > 10 and c.rows(job.outbox.read().drop("batch")) == sorted(wanted, key=repr)


@pytest.mark.parametrize("block", [4, 1000])
def test_places_are_those_of_a_ranking_at_each_moment(spark, block):
    import random

    rng = random.Random(block)
    names = {n: f"n{rng.randint(0, 10**6)}-{n}" for n in range(1, 41)}
    start = {n: rng.randint(0, 3) for n in names if n % 5}
    moves = [(rng.randint(1, 42), datetime(2026, 6, 11) + timedelta(minutes=m), m, rng.choice((-1, 1, 2))) for m in range(30) for _ in range(rng.randint(0, 20))]
    moments = [(datetime(2026, 6, 11) + timedelta(minutes=m), m) for m in range(30) if m % 4]
    asked = [1, 7, 7, 40, 99]
    named = order_statistics.by_name(spark.createDataFrame(list(names.items()), "user_id long, username string"), block)
    got = order_statistics.places_at(
        named, spark.createDataFrame(list(start.items()), "user_id long, points long"),
        spark.createDataFrame(moves, "user_id long, ts timestamp, event_id long, delta long"),
        spark.createDataFrame(moments, "ts timestamp, event_id long"), spark.createDataFrame([(a,) for a in asked], "user_id long"), block)
    wanted = []
    for _, event in moments:
        points = {n: start.get(n, 0) + sum(d for u, _, m, d in moves if u == n and m <= event) for n in names}
        table = sorted(names, key=lambda n: (-points[n], names[n]))
        wanted += [(event, u, table.index(u) + 1) for u in (1, 7, 40)]
    assert c.rows(got, "event_id", "user_id", "position") == sorted(wanted, key=repr)


def test_blocks_of_one_contest_are_worked_on_by_several_tasks(spark):
    """15,000 users at a moment: several blocks, a partition each, and lists taken apart by tasks of the product's size."""
    users = spark.range(15_000).select(F.col("id").alias("user_id"), F.format_string("n%05d", "id").alias("username"))
    start = users.select("user_id", (F.col("user_id") % 7).alias("points"))
    moves = spark.createDataFrame([(3, datetime(2026, 6, 11), 1, 4)], "user_id long, ts timestamp, event_id long, delta long")
    moments = moves.select("ts", "event_id")
    named = order_statistics.by_name(users)
    assert named.select("block").distinct().count() >= 7
    asked = users.where("user_id % 5 = 0")
    got = {r.user_id: r.position for r in order_statistics.places_at(named, start, moves, moments, asked).collect()}
    points = {n: n % 7 + (4 if n == 3 else 0) for n in range(15_000)}
    table = sorted(points, key=lambda n: (-points[n], n))
    assert got == {n: place for place, n in enumerate(table, 1) if n % 5 == 0}


def test_messages_of_a_moment_go_to_unranked_and_nameless_users_too(spark):
    done = c.finished(spark, "1X").withColumn("event_id", F.col("match_id") + 1)
    subs = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 9, "c"), (4, None, "d")], "sub_id long, user_id long, endpoint string")
    table = spark.createDataFrame(
        [(11, 1, 5, None), (21, 1, 5, None)], "event_id long, user_id long, position long, prev_position long")
    got = outbox.finish_outbox(done, subs, c.picks(spark, {1: "11"}), table, "event_id", table.select("user_id"))
    lines = {(r.event_id, r.sub_id): r.body.split("\n")[2:] for r in got.collect()}
    assert len(lines) == 8 and lines[11, 3] == lines[21, 4] == []
    assert lines[11, 1] == lines[11, 2] and [len(lines[e, 1]) for e in (11, 21)] == [2, 2]
    assert lines[11, 1][0] != lines[21, 1][0]


def test_a_grid_follows_the_product():
    assert grid(1000, 72) == (1, 1)
    assert grid(10**8, 72) == (7200, 1)
    down, across = grid(10**6, 10**6)
    assert down == across == 1000
    assert grid(1, 10**9) == (1, 1000) and grid(0, 0) == (1, 1)


def test_a_product_of_two_sides_above_the_broadcast_limit(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(300).withColumnRenamed("id", "user_id")
        columns = spark.range(200).select(F.col("id").alias("match_id"), F.lit("x").alias("unasked"))
        got = for_each(rows, columns, ["match_id"], cell_rows=2_000, whole_rows=50)
        placed = got.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
        assert len(placed) > 10 and max(p["count"] for p in placed) < 3 * 60_000 / len(placed)
        assert got.count() == got.distinct().count() == 60_000 and got.columns == ["user_id", "match_id"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Cartesian" not in plan
        whole = for_each(rows, columns, ["match_id"], cell_rows=2_000)
        assert c.rows(whole) == c.rows(got)
        assert whole.select(F.spark_partition_id()).distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_task_writes_far_more_picks_than_the_others(spark, tmp_path):
    """72 matches, one of them with a third of all picks."""
    import pyarrow.parquet as pq

    users = spark.range(0, 200_000, 1, 6).select(F.col("id").alias("user_id"))
    match = F.when(F.col("user_id") % 3 == 0, 7).otherwise(F.col("user_id") % 72 + 1).cast("long")
    picks = users.select("user_id", match.alias("match_id"), F.lit("1").alias("predicted_result"))
    log = PickLog(spark, str(tmp_path / "picks"), picks.schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log.write(picks, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {}
    for file in tmp_path.rglob("*.parquet"):
        part = file.name.split("-")[1]
        tasks[part] = tasks.get(part, 0) + pq.ParquetFile(file).metadata.num_rows
    assert len(tasks) == 8 and max(tasks.values()) <= 2 * 200_000 / 8
    wanted = picks.where("match_id in (7, 9)")
    got = log.of(spark.createDataFrame([(7,), (9,)], "match_id long")).where("match_id in (7, 9)")
    assert got.count() == wanted.count() and c.rows(got.where("user_id < 300")) == c.rows(wanted.where("user_id < 300"))


def test_the_outbox_needs_no_frame_of_users_and_turns(spark, game, monkeypatch):
    """What the product function makes: blocks and turns, subscriptions and turns."""
    people, matches, edits, picks = game
    asked = []

    def watched(df, small, columns, **more):
        asked.append(df.columns)
        return for_each(df, small, columns, **more)
    monkeypatch.setattr(order_statistics, "for_each", watched)
    monkeypatch.setattr(outbox, "for_each", watched)
    subs = spark.createDataFrame([(1, 1, "e")], "sub_id long, user_id long, endpoint string")
    job = FinishOutboxJob(people, spark.createDataFrame(picks, PICKS), matches, subs)
    job.on_batch(spark.createDataFrame(edits, EDITS), 0)
    assert asked == [["block"], ["sub_id", "user_id", "endpoint"]]


def test_messages_to_more_subscriptions_than_ten_thousand_need_no_shuffle_of_the_product(spark):
    """15,000 subscriptions and turns of two matches: sides of the product go to every task whole, nothing of it is sorted."""
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = c.finished(spark, "1X").withColumn("event_id", F.col("match_id") + 1)
        subs = spark.range(15_000).select("id", (F.col("id") % 7_500).alias("user_id"), F.lit("e").alias("endpoint")).withColumnRenamed("id", "sub_id")
        users = spark.range(7_500).withColumnRenamed("id", "user_id")
        table = users.crossJoin(done.select("event_id")).select(
            "event_id", "user_id", (F.col("user_id") + 1).alias("position"), F.lit(None).cast("long").alias("prev_position"))
        got = outbox.finish_outbox(done, subs, c.picks(spark, {1: "11"}), table, "event_id", users)
        joins = re.findall(r"SortMergeJoin.*", got._jdf.queryExecution().executedPlan().toString())
        assert all(re.search("LeftAnti|LeftSemi", join) for join in joins)
        rows = got.select("event_id", "sub_id", F.substring_index("body", "\n", -1).alias("line")).collect()
        assert len(rows) == 30_000 and {r.line for r in rows if r.sub_id in (4, 7_504)} == {"📊 Posición: 5°"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("wide", [1, 10**6])
def test_a_report_has_the_histogram_and_the_place_in_it(wide):
    import numpy as np

    points, here = np.array([3, -2, 3, 9, -2, 3, 0]) * wide, np.array([True, True, True, False, True, True, False])
    found = order_statistics._report(points, here, np.array([1, 4, 5]))
    assert [a.tolist() for a in found] == [[-2 * wide, 3 * wide], [2, 3], [0, 0, 1], [0, 1, 2]]
    assert [a.tolist() for a in order_statistics._report(points, here & False, np.array([], dtype=int))] == [[], [], [], []]


def test_reports_of_a_batch_go_when_its_messages_are_written(spark, game):
    people, matches, edits, picks = game
    subs = spark.createDataFrame([(1, 1, "e")], "sub_id long, user_id long, endpoint string")
    job = FinishOutboxJob(people, spark.createDataFrame(picks, PICKS), matches, subs)
    job.on_batch(spark.createDataFrame(edits, EDITS), 0)
    assert job.outbox.last() == 0 and job.reports.last() is None

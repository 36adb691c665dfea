"""Streams give what one batch over the same input gives, however the input is cut."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import contest as c
from poolboard.operators import outbox, ranking, scoring
from poolboard.session import fresh_path
from poolboard.sources.projections import Relations, attempt_columns
from poolboard.streaming import intake
from poolboard.streaming.logs import MergedLog, table_stream
from poolboard.streaming.points import PointsJob, stream_finish_outbox, stream_points
from poolboard.streaming.subscriptions import stream_subscriptions


def in_files(spark, df, path, order, parts):
    """Write ``df`` cut into ``parts`` files that arrive in ``order``."""
    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return table_stream(spark, str(path), files_per_trigger=1)


def replay(attempts, orders):
    """The rule, one attempt at a time."""
    done, verdicts = {}, {}
    for a in sorted(attempts, key=lambda r: (r.user_id, r.created_at, r.match_id, r.order_key, r.line_number, r.part_key)):
        order, k = orders.get(a.match_id), done.get(a.user_id, 0)
        if order is None:
            verdict = "unknown_match"
        elif order <= k:
            verdict = "duplicate"
        elif order == k + 1:
            verdict, done[a.user_id] = "accepted", order
        else:
            verdict = "out_of_sequence"
        verdicts[(a.user_id, a.match_id, a.order_key, a.line_number, a.part_key)] = verdict
    return verdicts


@pytest.fixture(scope="module")
def log_rows(spark):
    rows = [(i, (i * 7 % 5 + 1) * 10, f"2026-06-11 10:{i:02d}:00", "finish" if i % 3 else "save",
             str(i * 3 % 4), "x" if i % 11 == 0 else str(i % 3)) for i in range(40)]
    return spark.createDataFrame(
        rows, "event_id long, match_id long, ts string, action string, home_goals string, away_goals string"
    ).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def game(spark):
    matches = c.fixtures(spark, (1, "finished", 1, 0, "1"), *[(i, "pending", None, None, None) for i in range(2, 6)])
    return c.people(spark, "ana", "bea", "cai"), c.picks(spark, {1: "1X211", 2: "22X1X"}), matches


def test_points_follow_the_last_finish(spark, log_rows, game, tmp_path):
    who, chosen, matches = game
    edits = scoring.valid_edits(log_rows)
    last = edits.where("action = 'finish'").agg(F.max("event_id")).first()[0]
    wanted = scoring.user_points(who, chosen, scoring.match_results_apply(
        matches, log_rows.where(F.col("event_id") <= last))).select("user_id", "username", "total_points")
    for parts in (1, 4):
        stream = in_files(spark, log_rows, tmp_path / f"log{parts}", ["event_id"], parts)
        assert c.rows(stream_points(stream, who, chosen, matches)) == c.rows(wanted)


def test_restarted_job_goes_on_where_it_stopped(spark, log_rows, game, tmp_path):
    who, chosen, matches = game
    source, root = str(tmp_path / "growing"), str(tmp_path / "root")
    half = in_files(spark, log_rows.where("event_id < 17"), source, ["event_id"], 2)
    stream_points(half, who, chosen, matches, root)
    rest = in_files(spark, log_rows.where("event_id >= 17"), source, ["event_id"], 2)
    got = stream_points(rest, who, chosen, matches, root)
    whole = PointsJob(chosen, matches)
    whole.on_batch(log_rows, 0)
    assert c.rows(got) == c.rows(whole.totals(who))


def test_points_stay_stale_after_a_plain_save(spark, game, tmp_path):
    who, chosen, matches = game
    types = "event_id long, match_id long, ts timestamp, action string, home_goals string, away_goals string"
    finish = spark.createDataFrame([(1, 20, datetime(2026, 6, 11, 10), "finish", "1", "1")], types)
    undo = spark.createDataFrame([(2, 20, datetime(2026, 6, 11, 11), "save", "1", "1")], types)
    job = PointsJob(chosen, matches)
    job.on_batch(undo.where("false"), 0)
    assert c.by(job.totals(who), "user_id", "total_points") == {1: 0, 2: 0, 3: 0}
    job.on_batch(finish, 1)
    assert c.by(job.totals(who), "user_id", "total_points") == {1: 2, 2: 0, 3: 0}
    job.on_batch(undo, 2)
    assert c.by(job.totals(who), "user_id", "total_points") == {1: 2, 2: 0, 3: 0}
    job.on_batch(finish.withColumn("match_id", F.lit(30).cast("long")).withColumn(
        "ts", F.lit("2026-06-11 12:00").cast("timestamp")), 3)
    assert c.by(job.totals(who), "user_id", "total_points") == {1: 1, 2: 1, 3: 0}


def test_repeated_batch_changes_nothing(spark, log_rows, game):
    who, chosen, matches = game
    job = PointsJob(chosen, matches)
    job.on_batch(log_rows.where("event_id < 20"), 0)
    job.on_batch(log_rows.where("event_id >= 20"), 1)
    once = c.rows(job.totals(who))
    job.on_batch(log_rows.where("event_id >= 20"), 1)
    assert c.rows(job.totals(who)) == once


def test_merged_log_folds_every_few_batches(spark):
    def total(df):
        return df.groupBy("k").agg(F.sum("n").alias("n"))

    log = MergedLog(spark, fresh_path(spark, "sums"), "k string, n bigint", total, every=3)
    for i in range(8):
        log.write(spark.createDataFrame([("a", 1), (f"b{i % 2}", 1)], "k string, n bigint"), i)
    assert c.rows(log.state()) == [("a", 8), ("b0", 4), ("b1", 4)]
    assert c.rows(log.state(before=4)) == [("a", 4), ("b0", 2), ("b1", 2)]
    assert c.rows(log.state(before=0)) == []
    assert c.rows(log.log.read(6, 7), "k", "n") == [("a", 7), ("b0", 4), ("b1", 3)]


def test_a_message_for_each_turn_however_the_edits_are_cut(spark, log_rows, game, tmp_path):
    who, chosen, matches = game
    subs = spark.createDataFrame([(1, 1, "e"), (2, 2, "e")], "sub_id long, user_id long, endpoint string")
    wanted, done = [], {r.match_id: r.status == "finished" for r in matches.collect()}
    edits = sorted(scoring.valid_edits(log_rows).collect(), key=lambda e: (e.ts, e.event_id))
    for e in edits:  # the rule, one edit at a time
        if e.action == "finish" and not done[e.match_id]:
            after = scoring.match_results_apply(matches, log_rows.where(F.col("event_id") <= e.event_id))
            table = ranking.notify_ranking(scoring.user_points(who, chosen, after)).withColumn(
                "prev_position", F.lit(None).cast("long"))
            sent = outbox.finish_outbox(after.where(F.col("match_id") == e.match_id), subs, chosen, table)
            wanted += [(e.event_id, *r) for r in c.rows(sent)]
        done[e.match_id] = e.action == "finish"
    assert len(wanted) > 10
    for parts in (1, 4, 25):
        stream = in_files(spark, log_rows, tmp_path / f"cut{parts}", ["event_id"], parts)
        got = stream_finish_outbox(stream, who, chosen, matches, subs)
        assert c.rows(got) == sorted(wanted, key=repr), parts


def test_old_batches_go_after_a_fold(spark):
    def total(df):
        return df.groupBy("k").agg(F.sum("n").alias("n"))

    log = MergedLog(spark, fresh_path(spark, "folds"), "k string, n bigint", total, every=2)
    for i in range(9):
        log.write(spark.createDataFrame([("a", 1)], "k string, n bigint"), i)
    assert c.rows(log.state()) == [("a", 9)] and log.log.last() == 8
    assert log.log.read(0, 6).count() == 0 and log.log.read(6, 9).count() > 0
    only = spark.createDataFrame([("b",)], "k string")
    assert log.state(only=only).count() == 0


def test_intake_of_a_hundred_matches_over_many_partitions(spark):
    """More matches than a contest has, a user spread over partitions, and any cut."""
    rows = [(1 if i % 4 else 2, i * 37 % 101 + 1, "1", datetime(2026, 6, 11) + timedelta(seconds=i), i, 1, 1)
            for i in range(6000)]
    attempts = spark.createDataFrame(
        rows, "user_id long, match_id long, predicted_result string, created_at timestamp, order_key long, "
              "line_number int, part_key long")
    matches = spark.createDataFrame([(m, m) for m in range(1, 101)], "match_id long, match_order long")
    wanted = replay(attempts.collect(), {m: m for m in range(1, 101)})
    assert sum(v == "accepted" for v in wanted.values()) > 60
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        none = spark.createDataFrame([], "user_id long, done long")
        for cuts in ([6000], [1500, 4000, 6000]):
            got, done, start = {}, none, 0
            for end in cuts:
                part = attempts.where((F.col("order_key") >= start) & (F.col("order_key") < end))
                found = intake.judged(part, matches, done).checkpoint()
                got |= {(v.user_id, v.match_id, v.order_key, v.line_number, v.part_key): v.verdict for v in found.collect()}
                more = found.where("verdict = 'accepted'").groupBy("user_id").agg(F.max("match_order").alias("done"))
                done, start = done.unionByName(more).groupBy("user_id").agg(F.max("done").alias("done")), end
            assert got == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_subscriptions_keep_the_last_write(spark, small_dir, tmp_path):
    log = Relations(spark, small_dir).subscription_log()
    stream = in_files(spark, log, tmp_path / "subs", ["event_id"], 3)
    assert c.rows(stream_subscriptions(stream)) == c.rows(outbox.subscription_upsert(log))


def test_intake_equals_replay_in_any_cut(spark, small_dir, tmp_path):
    r = Relations(spark, small_dir)
    attempts = r.table("lineitem").select(*attempt_columns())
    orders = {row.match_id: row.match_order for row in r.d_fixtures().collect()}
    wanted = replay(attempts.collect(), orders)
    for parts in (1, 3):
        stream = in_files(spark, attempts, tmp_path / f"a{parts}", ["created_at", *intake.ARRIVAL[1:]], parts)
        got = intake.stream_intake(stream, r.d_fixtures()).read().collect()
        assert {(v.user_id, v.match_id, v.order_key, v.line_number, v.part_key): v.verdict for v in got} == wanted


def test_intake_of_one_user_over_many_partitions(spark):
    """Everything from one user: rows lie in several partitions, the result is that of one pass."""
    rows = [(1 if i % 10 else 2, i * 5 % 9 + 1, "1", datetime(2026, 6, 11) + timedelta(seconds=i), i, 1, 1)
            for i in range(3000)]
    attempts = spark.createDataFrame(
        rows, "user_id long, match_id long, predicted_result string, created_at timestamp, order_key long, "
              "line_number int, part_key long")
    matches = spark.createDataFrame([(m, m) for m in range(1, 9)], "match_id long, match_order long")
    progress = spark.createDataFrame([(2, 3)], "user_id long, done long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = intake.judged(attempts, matches, progress).withColumn("slice", F.spark_partition_id()).checkpoint()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("user_id = 1").select("slice").distinct().count() > 3
    alone = replay([a for a in attempts.collect() if a.user_id == 1], {m: m for m in range(1, 9)})
    mine = {(v.user_id, v.match_id, v.order_key, v.line_number, v.part_key): v.verdict
            for v in got.where("user_id = 1").collect()}
    assert mine == alone
    resumed = [v.match_order for v in got.where("user_id = 2 and verdict = 'accepted'").orderBy("created_at").collect()]
    assert resumed == list(range(4, 9))


def test_votes_follow_accepted_picks(spark, small_dir, tmp_path):
    r = Relations(spark, small_dir)
    attempts = r.table("lineitem").select(*attempt_columns())
    verdicts = intake.stream_intake(in_files(spark, attempts, tmp_path / "v", ["created_at"], 2), r.d_fixtures())
    got = intake.stream_consensus(intake.accepted_stream(verdicts), r.d_fixtures())
    accepted = verdicts.read().where("verdict = 'accepted'").count()
    assert got.count() == 72
    assert got.agg(F.sum("votes_total")).first()[0] == accepted > 0
    assert got.where("votes_1 + votes_x + votes_2 <> votes_total").count() == 0

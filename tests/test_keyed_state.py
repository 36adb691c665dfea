"""Intake from keyed state, and deliveries that come again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import contest as c
from poolboard.operators import scoring
from poolboard.sources.arrivals import let_arrive, read_log, write_log
from poolboard.streaming import intake
from poolboard.streaming.logs import BatchLog, once, rocks_state, run_to_end
from poolboard.streaming.points import stream_finish_outbox, stream_points

ATTEMPTS = ("user_id long, match_id long, predicted_result string, created_at timestamp, order_key long, "
            "line_number int, part_key long")
EDITS = "event_id long, match_id long, ts timestamp, action string, home_goals string, away_goals string"
START = datetime(2026, 6, 11)


@pytest.fixture(scope="module")
def attempts(spark):
    """Three users, one with most attempts, unknown matches and equal times."""
    rows = [((1, 1, 1, 2, 3)[i % 5], i * 7 % 13 + 1, "1", START + timedelta(seconds=i // 3), i, 1, i % 4) for i in range(900)]
    return spark.createDataFrame(rows, ATTEMPTS)


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame([(m, m) for m in range(1, 11)], "match_id long, match_order long")


@pytest.mark.parametrize("parts", [1, 4])
def test_keyed_verdicts_are_those_of_the_folded_logs(spark, attempts, matches, tmp_path, parts):
    path = str(tmp_path / "log")
    write_log(attempts, path, intake.ARRIVAL)
    wanted = intake.judged(attempts, matches, spark.createDataFrame([], "user_id long, done long"))
    log, state = intake.stream_intake_keyed(read_log(spark, path, attempts.schema), matches, arriving=let_arrive(path, parts))
    assert c.rows(log.read().drop("batch")) == c.rows(wanted)
    assert state["users"] == 3 and state["bytes"] > 0
    assert (log.last() or 0) >= parts - 1


def test_a_restarted_keyed_intake_knows_how_far_each_user_is(spark, attempts, matches, tmp_path):
    path, root = str(tmp_path / "log"), str(tmp_path / "root")
    early = attempts.where("order_key < 300")
    write_log(early, f"{path}/1", intake.ARRIVAL)
    intake.stream_intake_keyed(read_log(spark, path, attempts.schema), matches, root)
    write_log(attempts.where("order_key >= 300"), f"{path}/2", intake.ARRIVAL)
    log, _ = intake.stream_intake_keyed(read_log(spark, path, attempts.schema), matches, root)
    wanted = intake.judged(attempts, matches, spark.createDataFrame([], "user_id long, done long"))
    assert c.rows(log.read().drop("batch")) == c.rows(wanted)


def test_a_bucket_keeps_the_state_of_its_users(spark, matches, tmp_path):
    """Forty users in three buckets, apart from null users; whole numbers beyond 2**53 stay whole beside nulls."""
    rows = [(user, match, "1", START + timedelta(seconds=n), (1 << 60) + user if user % 2 else None, 1, 0)
            for n, match in enumerate((1, 2, 2, 4, 3, 99)) for user in range(40)]
    nobody = [(None, 99, "1", START, 5, 1, 0)] * 5
    attempts = spark.createDataFrame(rows + nobody, ATTEMPTS)
    path, root = str(tmp_path / "log"), str(tmp_path / "root")
    write_log(attempts, path, intake.ARRIVAL)
    log = BatchLog(spark, f"{root}/verdicts", intake.VERDICTS.format(user="long"))
    stream = intake.keyed_verdicts(read_log(spark, path, attempts.schema), matches, buckets=3)
    with rocks_state(spark):
        last = run_to_end(stream, log.write, root, arriving=let_arrive(path, 2))
    verdicts = ("accepted", "accepted", "duplicate", "out_of_sequence", "accepted", "unknown_match")
    wanted = [(r[0], r[3], r[4], verdicts[n // 40]) for n, r in enumerate(rows)]
    got = [(r.user_id, r.created_at, r.order_key, r.verdict) for r in log.read().where("user_id IS NOT NULL").collect()]
    assert log.read().where("user_id IS NULL AND verdict = 'unknown_match'").count() == 5
    assert sorted(got, key=lambda r: r[:2]) == sorted(wanted, key=lambda r: r[:2])
    assert last["stateOperators"][0]["numRowsTotal"] <= 3


@pytest.fixture(scope="module")
def game(spark):
    fixtures = c.fixtures(spark, *[(i, "pending", None, None, None) for i in range(1, 6)])
    return c.people(spark, "ana", "bea", "cai"), c.picks(spark, {1: "1X211", 2: "22X1X"}), fixtures


@pytest.fixture(scope="module")
def edits():
    return [(i, (i * 7 % 5 + 1) * 10, START + timedelta(minutes=i), "finish" if i % 3 else "save", str(i * 3 % 4), str(i % 3))
            for i in range(40)]


def delivered(spark, path, rows, parts, delay="1 hour"):
    """Rows with a last column of the time of delivery, as a stream without repeats."""
    frame = spark.createDataFrame(rows, EDITS + ", at timestamp")
    write_log(frame, path, ["at", "event_id"])
    schema = frame.drop("at").schema
    return once(read_log(spark, path, schema), ["event_id"], "ts", delay), let_arrive(path, parts)


def test_a_file_that_is_replayed_changes_no_total(spark, game, edits, tmp_path):
    who, chosen, matches = game
    twice = [(*e, e[2]) for e in edits] + [(*e, e[2] + timedelta(minutes=25)) for e in edits[:30]]
    wanted = scoring.user_points(who, chosen, scoring.match_results_apply(matches, spark.createDataFrame(edits[:39], EDITS)))
    for parts in (1, 6):
        stream, arriving = delivered(spark, str(tmp_path / f"log{parts}"), twice, parts)
        got = stream_points(stream, who, chosen, matches, arriving=arriving)
        assert c.rows(got) == c.rows(wanted, "user_id", "username", "total_points")


def test_an_old_finish_that_comes_again_writes_no_second_message(spark, game, edits, tmp_path):
    who, chosen, matches = game
    subs = spark.createDataFrame([(1, 1, "e"), (2, 2, "e")], "sub_id long, user_id long, endpoint string")
    single = [(*e, e[2]) for e in edits]
    stream, arriving = delivered(spark, str(tmp_path / "one"), single, 4)
    wanted = c.rows(stream_finish_outbox(stream, who, chosen, matches, subs, arriving=arriving))
    again = single + [(*e, e[2] + timedelta(minutes=11)) for e in edits if e[3] == "finish"]
    stream, arriving = delivered(spark, str(tmp_path / "two"), again, 4)
    assert c.rows(stream_finish_outbox(stream, who, chosen, matches, subs, arriving=arriving)) == wanted and wanted


def test_state_of_repeats_stays_bounded_over_fifty_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(5_000).select(F.col("id"), F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") * 60).alias("at"))
    write_log(rows.unionByName(rows.where("id % 3 = 0")), path, ["at", "id"])
    seen, sizes = [], []

    def on_batch(batch, number):
        seen.extend(r.id for r in batch.collect())
    stream = once(read_log(spark, path, rows.schema, tasks=2), ["id"], "at", "30 minutes")
    with rocks_state(spark):
        steps = let_arrive(path, 50)
        for _ in steps:
            last = run_to_end(stream, on_batch, str(tmp_path / "root"))
            sizes += [last["stateOperators"][0]["numRowsTotal"]] if last and last["stateOperators"] else []
            if len(sizes) == 6:
                break
        last = run_to_end(stream, on_batch, str(tmp_path / "root"), arriving=steps)
    sizes.append(last["stateOperators"][0]["numRowsTotal"])
    assert sorted(seen) == list(range(5_000))
    assert max(sizes) < 400  # 30 minutes and a batch of 100 minutes, of 5,000

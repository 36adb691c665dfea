"""Picks as they arrive: accept the next one in order, reject the rest; running votes on top.

A user's accepted picks are always matches 1..k, so all that must be known of a user is k.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stats import VOTES
from ..session import shared_dir
from .logs import BatchLog, MergedLog, job_root, rocks_state, run_to_end, table_stream

ARRIVAL = ["created_at", "match_id", "order_key", "line_number", "part_key"]
VERDICTS = ("user_id {user}, match_id bigint, predicted_result string, created_at timestamp, order_key bigint, "
            "line_number int, part_key bigint, match_order bigint, verdict string")
PROGRESS = "user_id {user}, done bigint"
#: Columns whose nulls go to the keyed intake as bits.
BLANKS = ["user_id", "match_id", "order_key", "line_number", "part_key", "match_order"]
#: Buckets of users in the state of the keyed intake.
BUCKETS = 512
COUNTS = "match_id bigint, votes_1 bigint, votes_x bigint, votes_2 bigint, votes_total bigint, counted_in bigint"


def _user_type(attempts: DataFrame) -> str:
    return attempts.schema["user_id"].dataType.simpleString()


class _Piece:
    """A user's attempts in a row, by order of match: where each order occurs, sorted by arrival."""

    def __init__(self, orders: np.ndarray):
        self.orders = orders
        by_order = np.argsort(orders, kind="stable")
        known, starts = np.unique(orders[by_order], return_index=True)
        ends = [*starts[1:].tolist(), len(orders)]
        self.at = {o: by_order[a:b] for o, a, b in zip(known.tolist(), starts.tolist(), ends, strict=True) if o > 0}

    def accepted(self, done: int) -> dict[int, int]:
        """Row of each order accepted after ``done``: every next one at its first place behind the last."""
        rows, behind = {}, -1
        while done + 1 in self.at:
            places = self.at[done + 1]
            n = np.searchsorted(places, behind, side="right")
            if n == len(places):
                break
            done, behind = done + 1, int(places[n])
            rows[done] = behind
        return rows

    def moves(self) -> dict[int, int]:
        """The k after the rows for every k before them that they move.

        From the highest order down: a place leads to the first later place of the next order, and on from there.
        """
        last: dict[int, np.ndarray] = {}
        for order in sorted(self.at, reverse=True):
            places, last[order] = self.at[order], np.full(len(self.at[order]), order)
            if order + 1 in self.at:
                n = np.searchsorted(self.at[order + 1], places, side="right")
                more = n < len(self.at[order + 1])
                last[order][more] = last[order + 1][n[more]]
        return {order - 1: int(ends[0]) for order, ends in last.items()}


def _pieces(rows: pd.DataFrame) -> Iterator[tuple[object, slice]]:
    """Runs of one user in rows sorted by user."""
    users = rows["user_id"].to_numpy()
    cuts = np.flatnonzero(users[1:] != users[:-1]) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(users)], strict=True):
        if end > start:
            yield users[start], slice(start, end)


def _orders(rows: pd.DataFrame) -> np.ndarray:
    return rows["match_order"].fillna(0).to_numpy(dtype=np.int64)


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verdicts for rows sorted by user and arrival; ``start`` is the user's k ahead of the partition."""
    last, done = None, 0
    for rows in batches:
        orders, starts = _orders(rows), rows["start"].to_numpy()
        verdicts = np.full(len(rows), "out_of_sequence", dtype=object)
        for user, piece in _pieces(rows):
            done = done if user == last else int(starts[piece.start])
            last, own, part = user, orders[piece], verdicts[piece]
            taken = _Piece(own).accepted(done)
            part[(own > 0) & (own <= done)] = "duplicate"
            if taken:
                at = np.full(done + len(taken) + 1, len(own))
                at[list(taken)] = list(taken.values())
                reached = (own > done) & (own <= done + len(taken))
                behind = np.flatnonzero(reached)[np.flatnonzero(reached) > at[own[reached]]]
                part[behind] = "duplicate"
                part[list(taken.values())] = "accepted"
                done += len(taken)
            part[own == 0] = "unknown_match"
        yield rows.drop(columns=["start"]).assign(verdict=verdicts, match_order=rows["match_order"].astype("Int64"))


def _moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each user of a partition, the k after its rows for every k before them that they move.

    Only users whose rows lie in several partitions come here. A user's rows of one partition are put together.
    """
    held: list[tuple] = []

    def moved() -> pd.DataFrame:
        user, part = held[0][:2]
        steps = _Piece(np.concatenate([orders for _, _, orders in held])).moves()
        return pd.DataFrame({"user_id": [user], "part": [part], "before": [list(steps)], "after": [list(steps.values())]})

    for rows in batches:
        orders, parts = _orders(rows), rows["part"].to_numpy()
        for user, piece in _pieces(rows):
            if held and held[0][0] != user:
                yield moved()
                held.clear()
            held.append((user, int(parts[piece.start]), orders[piece]))
    if held:
        yield moved()


def _starts(placed: DataFrame) -> DataFrame:
    """Where each part of a user's rows starts, for the users whose rows lie in several partitions.

    A partition shares at most its first and last user with others, so at most two rows per partition are broadcast.
    """
    user = _user_type(placed)
    split = placed.groupBy("user_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    pieces = placed.join(F.broadcast(split.select("user_id")), "user_id", "left_semi")
    moves = pieces.select("user_id", "part", "match_order").mapInPandas(
        _moves, f"user_id {user}, part int, before array<bigint>, after array<bigint>")
    known = pieces.groupBy("user_id").agg(F.max("done").alias("done"))
    in_order = F.array_sort(F.collect_list(F.struct("part", "before", "after")))
    first = F.struct(F.col("done").alias("k"), F.array().cast("array<struct<part:int,start:bigint>>").alias("starts"))
    walked = F.aggregate("moves", first, lambda acc, m: F.struct(
        F.coalesce(F.map_from_arrays(m["before"], m["after"])[acc["k"]], acc["k"]).alias("k"),
        F.array_append(acc["starts"], F.struct(m["part"].alias("part"), acc["k"].alias("start"))).alias("starts")))
    return (moves.groupBy("user_id").agg(in_order.alias("moves")).join(known, "user_id")
            .select("user_id", F.inline(walked["starts"])))


def judged(attempts: DataFrame, fixtures: DataFrame, progress: DataFrame) -> DataFrame:
    """A verdict for every attempt, in order of arrival, on top of earlier ``progress`` (user_id, done).

    Rows are range partitioned by user and arrival, so a user with very many attempts is
    spread over partitions; the checkpoint keeps that order through the two passes.
    """
    shared_dir(attempts.sparkSession)
    verdicts = VERDICTS.format(user=_user_type(attempts))
    keys = [F.col(c) for c in ["user_id", *ARRIVAL]]
    placed = (attempts.join(fixtures.select("match_id", "match_order"), "match_id", "left")
              .join(progress, "user_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
              .repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("part", F.spark_partition_id()).checkpoint())
    start = F.coalesce("start", "done").alias("start")
    columns = ["user_id", "match_id", "predicted_result", *[c for c in ARRIVAL if c != "match_id"], "match_order"]
    return placed.join(F.broadcast(_starts(placed)), ["user_id", "part"], "left").select(
        *columns, start).mapInPandas(_judge, verdicts)


def _furthest(progress: DataFrame) -> DataFrame:
    return progress.groupBy("user_id").agg(F.max("done").alias("done"))


class IntakeJob:
    """Verdicts per micro-batch, and how far each user has come."""

    def __init__(self, attempts: DataFrame, fixtures: DataFrame, root: str | None = None):
        spark, user = attempts.sparkSession, _user_type(attempts)
        self.fixtures = fixtures
        self.root = job_root(spark, "intake", root)
        self.verdicts = BatchLog(spark, f"{self.root}/verdicts", VERDICTS.format(user=user))
        self.progress = MergedLog(spark, f"{self.root}/done", PROGRESS.format(user=user), _furthest)

    def on_batch(self, batch: DataFrame, number: int) -> None:
        users = batch.select("user_id").distinct()
        self.verdicts.write(judged(batch, self.fixtures, self.progress.state(number, only=users)), number)
        accepted = self.verdicts.read(number, number + 1).where(F.col("verdict") == "accepted")
        self.progress.write(_furthest(accepted.withColumnRenamed("match_order", "done")), number)


def stream_intake(attempts: DataFrame, fixtures: DataFrame, root: str | None = None,
                  arriving: Iterable | None = None) -> BatchLog:
    """Run the intake over all that has arrived; returns the log of verdicts."""
    job = IntakeJob(attempts, fixtures, root)
    run_to_end(attempts, job.on_batch, job.root, arriving=arriving)
    return job.verdicts


def _refilled(rows: pd.DataFrame) -> pd.DataFrame:
    """Nulls back where ``blanks`` has a bit; whole numbers stay whole beside them."""
    bits = rows["blanks"].to_numpy()
    for bit, c in enumerate(BLANKS):
        gone = (bits >> bit & 1) == 1
        if gone.all():
            rows[c] = None if rows[c].dtype == object else np.nan
        elif gone.any():
            rows[c] = rows[c].astype("Int64").mask(gone)
    return rows.drop(columns=["blanks"])


def _some_users(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Verdicts of the users of a bucket; what is kept of a user is how many matches are picked, in the state store.

    Null users share a bucket that holds nobody else.
    """
    held = _refilled(pd.concat(list(rows), ignore_index=True).drop(columns=["bucket"]))
    held = held.sort_values(["user_id", *ARRIVAL], kind="stable", ignore_index=True)
    known = dict(zip(*state.get, strict=True)) if state.exists else {}
    codes, found = pd.factorize(held["user_id"], use_na_sentinel=False)
    users = [None if pd.isna(user) else user for user in found.tolist()]
    done = np.array([known.get(user, 0) for user in users], dtype=np.int64)
    judged = next(_judge(iter([held.assign(start=done[codes])])))
    accepted = np.flatnonzero(judged["verdict"] == "accepted")
    if len(accepted):
        np.maximum.at(done, codes[accepted], _orders(judged)[accepted])
        known |= {user: k for user, k in zip(users, done.tolist(), strict=True) if k}
        state.update((list(known), list(known.values())))
    yield judged


def keyed_verdicts(attempts: DataFrame, fixtures: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of verdicts on a stream of attempts, from keyed state alone: no log is folded, no batch job is written.

    State is kept by bucket of users, as a call for each user costs more than the user's rows. A job that goes on has to
    keep its number of ``buckets``. A bucket's rows of one batch are put in order by one task; where one user may send
    very many at once, ``IntakeJob`` spreads them.
    """
    user = _user_type(attempts)
    verdicts = VERDICTS.format(user=user)
    known = attempts.join(fixtures.select("match_id", "match_order"), "match_id", "left")
    # pandas makes fractions of whole numbers beside nulls: nulls go as zeros and a bit each
    types = dict(part.split() for part in verdicts.split(", "))
    filled = [F.coalesce(c, F.lit(0).cast(types[c])).alias(c) if c in BLANKS else F.col(c).cast(types[c]).alias(c)
              for c in list(types)[:-1]]
    blanks = sum((F.col(c).isNull().cast("int") * (1 << bit) for bit, c in enumerate(BLANKS)), F.lit(0))
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("int")
    return known.select(*filled, blanks.alias("blanks"), bucket.alias("bucket")).groupBy("bucket").applyInPandasWithState(
        _some_users, verdicts, f"users array<{user}>, done array<bigint>", "append", GroupStateTimeout.NoTimeout)


def stream_intake_keyed(attempts: DataFrame, fixtures: DataFrame, root: str | None = None,
                        arriving: Iterable | None = None) -> tuple[BatchLog, dict]:
    """Run the keyed intake over all that has arrived; the log of verdicts, and users and bytes of its state."""
    spark = attempts.sparkSession
    root = job_root(spark, "intake", root)
    log = BatchLog(spark, f"{root}/verdicts", VERDICTS.format(user=_user_type(attempts)))
    with rocks_state(spark):
        last = run_to_end(keyed_verdicts(attempts, fixtures), log.write, root, arriving=arriving)
    # whoever is in the state has a first match
    first = log.read().where((F.col("verdict") == "accepted") & (F.col("match_order") == 1))
    return log, {"users": first.select("user_id").distinct().count(),
                 "bytes": last["stateOperators"][0]["memoryUsedBytes"] if last else 0}


def running_votes(picks: DataFrame) -> DataFrame:
    """Votes per match of a stream of accepted picks."""
    pick = F.col("predicted_result")
    return picks.groupBy("match_id").agg(
        *[F.count_if(pick == o).alias(c) for o, c in VOTES.items()], F.count("*").alias("votes_total"))


def _newest_counts(counts: DataFrame) -> DataFrame:
    columns = [*VOTES.values(), "votes_total", "counted_in"]
    return counts.groupBy("match_id").agg(F.max_by(F.struct(*columns), "counted_in").alias("v")).select(
        "match_id", "v.*")


def stream_consensus(accepted: DataFrame, fixtures: DataFrame, root: str | None = None) -> DataFrame:
    """Follow accepted picks to the end; every fixture with its votes, zeros included.

    Update mode hands over only the matches a batch touched; the newest row of each counts.
    """
    root = job_root(accepted.sparkSession, "consensus", root)
    log = MergedLog(accepted.sparkSession, f"{root}/votes", COUNTS, _newest_counts)

    def on_batch(batch: DataFrame, number: int) -> None:
        log.write(batch.withColumn("counted_in", F.lit(number).cast("long")), number)

    run_to_end(running_votes(accepted), on_batch, root, mode="update")
    counts = [*VOTES.values(), "votes_total"]
    return fixtures.select("match_id", "match_order").join(log.state(), "match_id", "left").select(
        "match_id", "match_order", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def accepted_stream(verdicts: BatchLog) -> DataFrame:
    """The accepted picks of an intake, as a stream of its own."""
    return table_stream(verdicts.spark, verdicts.path).where(F.col("verdict") == "accepted")

"""Subscriptions that follow a stream of writes; the last one wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.outbox import latest_writes
from .logs import MergedLog, job_root, run_to_end

PARTIAL = ("user_id {user}, endpoint string, sub_id bigint, p256dh string, auth string, created_at timestamp, event_id bigint")


def stream_subscriptions(writes: DataFrame, root: str | None = None, arriving: Iterable | None = None) -> DataFrame:
    """Each batch appends its newest write per key; reading merges them, so no batch rewrites the table."""
    user = writes.schema["user_id"].dataType.simpleString()
    root = job_root(writes.sparkSession, "subscriptions", root)
    log = MergedLog(writes.sparkSession, f"{root}/writes", PARTIAL.format(user=user), latest_writes)

    def on_batch(batch: DataFrame, number: int) -> None:
        log.write(latest_writes(batch.withColumn("sub_id", F.col("event_id"))), number)

    run_to_end(writes, on_batch, root, arriving=arriving)
    return log.state().select("sub_id", "user_id", "endpoint", "p256dh", "auth")

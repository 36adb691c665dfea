"""Tables grown by micro-batches: each batch owns one folder, so a repeated batch replaces itself.

A job keeps its logs and its progress below one root folder; started again with the same
root, it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class BatchLog:
    """Append-only log, partitioned by batch number."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.path = path
        self.schema = schema

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, since: int = 0, before: int | None = None) -> DataFrame:
        """Rows of batches from ``since`` up to, not including, ``before``; a batch that wrote nothing has no folder."""
        found = [f"{self.path}/batch={n}" for n in self._batches() if since <= n and (before is None or n < before)]
        schema = f"{self.schema}, batch bigint"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*found)

    def _batches(self) -> list[int]:
        store, place = self._store(self.path)
        if not store.exists(place):
            return []
        names = [entry.getPath().getName() for entry in store.listStatus(place)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def _store(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def last(self, before: int | None = None) -> int | None:
        """The newest batch, or the newest ahead of one, by the names of the folders."""
        return max((n for n in self._batches() if before is None or n < before), default=None)

    def drop(self, batch: int) -> None:
        """Remove a batch nobody reads any more."""
        store, place = self._store(f"{self.path}/batch={batch}")
        store.delete(place, True)


class MergedLog:
    """State as a log of changes that ``merge`` folds into one row per key.

    Every ``every``-th batch stores the folded state instead of its change alone, so a
    read never goes back further than that.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame],
                 every: int = 20):
        self.log = BatchLog(spark, path, schema)
        self.columns = [part.split()[0] for part in schema.split(", ")]
        self.merge = merge
        self.every = every

    def changes(self, before: int | None) -> DataFrame:
        """What ``merge`` makes the state of, ahead of a batch."""
        if before is None:
            last = self.log.last()
            before = 0 if last is None else last + 1
        since = max(before - 1, 0) // self.every * self.every
        return self.log.read(since, before).select(*self.columns)

    def state(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The state ahead of a batch, or the newest; ``only``: for the keys of that frame, which are looked up first."""
        changes = self.changes(before)
        if only is not None:
            changes = changes.join(only, only.columns, "left_semi")
        return self.merge(changes).select(*self.columns)

    def write(self, change: DataFrame, batch: int) -> None:
        """Add a batch. A folded batch makes those before the last fold useless; they go, as batches come in order."""
        change = change.select(*self.columns)
        folds = batch and batch % self.every == 0
        if folds:
            change = self.merge(self.changes(batch).unionByName(change)).select(*self.columns)
        self.log.write(change, batch)
        if folds:
            for old in range(max(0, batch - 2 * self.every), batch - self.every):
                self.log.drop(old)


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The parquet files of a folder, its subfolders, or whatever a pattern names, as a stream."""
    found = spark.read.option("recursiveFileLookup", True).parquet(path)
    reader = spark.readStream.schema(found.schema).option("recursiveFileLookup", True)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def job_root(spark: SparkSession, name: str, root: str | None) -> str:
    """The job's folder: the given one, or a new one in the shared folder."""
    return root or fresh_path(spark, name)


def run_to_end(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], root: str, mode: str = "append",
               arriving: Iterable | None = None) -> dict | None:
    """Process everything that has arrived since the last run with this root, then stop; returns the last progress.

    ``arriving``: the job keeps running while more arrives, and takes all there is after each step of the iterator.
    """
    job = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{root}/progress")
    if arriving is None:
        running = job.trigger(availableNow=True).start()
        running.awaitTermination()
        return running.lastProgress
    running = None
    for _ in arriving:
        running = running or job.start()
        running.processAllAvailable()
    if running is None:
        return None
    running.stop()
    return running.lastProgress


def once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """A stream in which rows that are delivered again, with the same ``keys``, count once.

    Keys are kept in the state store until event time ``at`` is ``delay`` past them. Rows that come later than that are
    left out, whether they are repeats or not, so ``delay`` has to cover how late a first delivery can be.
    """
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside keep keyed state in RocksDB, which spills to disk."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)

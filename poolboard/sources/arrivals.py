"""Rows in order of arrival as a stream: offsets are row numbers, a batch is a range of rows read by several tasks.

A log is a folder of parquet files; it grows by files whose names sort behind the earlier ones. Rows laid out at once can
still arrive in parts: empty files named after a number of rows say how many have arrived.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: A task reads at least and at most so many rows; in between a batch is dealt to ``tasks`` of them.
LEAST, MOST = 4_000, 1_000_000
#: Bytes of a row group of a log: a task that starts inside one decodes what lies before its rows.
GROUP_BYTES = 16 << 20
_ARRIVED = "_arrived-"


def write_log(df: DataFrame, path: str, order: list[str]) -> None:
    """Append rows to a log by ``order``, spread over tasks by ranges of it."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append")
     .option("parquet.block.size", GROUP_BYTES).parquet(path))


def read_log(spark: SparkSession, path: str, schema: T.StructType, tasks: int | None = None) -> DataFrame:
    """A stream over a log, with the columns of ``schema`` alone."""
    spark.dataSource.register(RowRanges)
    return spark.readStream.format(RowRanges.name()).schema(schema).option("path", path).option(
        "tasks", tasks or spark.sparkContext.defaultParallelism).load()


def let_arrive(path: str, parts: int) -> Iterator[int]:
    """Let the rows of a log arrive in parts; yields after each with the number of rows there are now."""
    store, folder = _in_place(path)
    total = RowRangeReader(T.StructType(), {"path": path}).rows()
    for n in range(1, parts + 1):
        store.open_output_stream(f"{folder}/{_ARRIVED}{total * n // parts}").close()
        yield total * n // parts


class RowRange(InputPartition):
    """``rows`` rows of a row group from its row ``first`` on."""

    def __init__(self, path: str, group: int, first: int, rows: int):
        self.path, self.group, self.first, self.rows = path, group, first, rows


class RowRanges(DataSource):
    """Options: ``path`` of the log and ``tasks`` per batch."""

    @classmethod
    def name(cls) -> str:
        return "row_ranges"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return RowRangeReader(schema, self.options)


def _in_place(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _by_number(path: str) -> list:
    """Sorts part 100000 behind part 99999."""
    return [int(part) if part.isdigit() else part for part in re.split(r"(\d+)", path)]


class RowRangeReader(DataSourceStreamReader):
    """Row counts come from the files' footers, which are read once each."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.store, self.path = _in_place(options["path"])
        self.tasks = int(options.get("tasks", 1))
        self.groups: dict[str, list[int]] = {}

    def _footer(self, path: str) -> list[int]:
        with self.store.open_input_file(path) as file:
            found = pq.ParquetFile(file).metadata
            return [found.row_group(n).num_rows for n in range(found.num_row_groups)]

    def _files(self) -> list[tuple[str, list[int]]]:
        found = [f.path for f in self.store.get_file_info(pafs.FileSelector(self.path, recursive=True, allow_not_found=True))]
        marks = [int(path.rpartition(_ARRIVED)[2]) for path in found if _ARRIVED in path]
        self.arrived = max(marks, default=None)
        paths = sorted((path for path in found if path.endswith(".parquet")), key=_by_number)
        new = [path for path in paths if path not in self.groups]
        with ThreadPoolExecutor(16) as pool:
            self.groups |= zip(new, pool.map(self._footer, new), strict=True)
        return [(path, self.groups[path]) for path in paths]

    def rows(self) -> int:
        return sum(sum(groups) for _, groups in self._files())

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        rows = self.rows()
        return {"row": rows if self.arrived is None else min(rows, self.arrived)}

    def partitions(self, start: dict, end: dict) -> list[RowRange]:
        size = min(MOST, max(LEAST, -(-(end["row"] - start["row"]) // self.tasks)))
        found, at = [], 0
        for path, groups in self._files():
            for group, rows in enumerate(groups):
                low, high = max(start["row"], at), min(end["row"], at + rows)
                found += [RowRange(path, group, row - at, min(size, high - row)) for row in range(low, high, size)]
                at += rows
        return found

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        first, left = partition.first, partition.rows
        with self.store.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(10_000, row_groups=[partition.group], columns=wanted.names):
                part = batch.slice(first, left)
                first, left = max(0, first - batch.num_rows), left - part.num_rows
                if part.num_rows:
                    yield from pa.Table.from_batches([part]).select(wanted.names).cast(wanted, safe=False).to_batches()
                if not left:
                    return

    def commit(self, end: dict) -> None:
        """Nothing to give back: the log keeps its rows."""

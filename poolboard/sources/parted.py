"""Relations in folders by the hash of a key: a change rewrites the folders it touches and leaves the other files alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import maintain
from ..session import fresh_path

PARTS = 64
_PART = "__part"


class PartedRelation:
    """``parts`` folders below ``path``; a row lies in the one of its ``key``. Null keys share a folder.

    A frame names the files it was read from: after a change, read again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, parts: int = PARTS):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path, schema, key, parts

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, parts: int = PARTS) -> PartedRelation:
        """Write ``df`` to a new folder; tasks take ranges of parts and rows, so a key of any size spreads over several."""
        table = cls(df.sparkSession, path, df.schema, key, parts)
        table._write(df, path, "errorifexists")
        return table

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias(_PART)

    def _write(self, df: DataFrame, path: str, mode: str) -> None:
        order = [_PART, self.key, F.xxhash64(*[c for c in df.columns if c != self.key] or [self.key])]
        (df.select("*", self._part()).repartitionByRange(*order).sortWithinPartitions(_PART, self.key)
         .write.mode(mode).partitionBy(_PART).parquet(path))

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts; only their folders are opened."""
        held = self._with_parts(self.path)
        return (held if parts is None else held.where(F.col(_PART).isin(parts))).drop(_PART)

    def _with_parts(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(_PART, T.IntegerType())])).parquet(path)

    def parts_of(self, keys: DataFrame) -> list[int]:
        """Parts where rows with these keys lie, or would lie. A number per part at most comes to the driver."""
        return sorted(r[0] for r in keys.select(self._part()).distinct().collect())

    def parts_with(self, wanted: DataFrame, column: str, value: str) -> list[int]:
        """Parts that hold rows whose ``column`` is among the ``value`` of ``wanted``; reads that column alone."""
        match = wanted.select(F.col(value).alias(column))
        found = self._with_parts(self.path).select(_PART, column).join(match, column, "left_semi")
        return sorted(r[0] for r in found.select(_PART).distinct().collect())

    def rewrite(self, parts: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of some parts by what ``change`` makes of them; it has to keep a row's key.

        The new rows are complete in a folder of their own before a file goes, and each part is replaced as a whole, so
        a change that can be repeated can be run again after a failure at any point.
        """
        if not parts:
            return
        staged = fresh_path(self.spark, "parts")
        self._write(change(self.read(parts)).select(*self.schema.names), staged, "errorifexists")
        new = self._with_parts(staged)
        (new.sortWithinPartitions(_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(_PART).parquet(self.path))
        for part in set(parts) - {r[0] for r in new.select(_PART).distinct().collect()}:
            self._drop(part)

    def _drop(self, part: int) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_PART}={part}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert_update(table: PartedRelation, incoming: DataFrame, keys: list[str], update: list[str]) -> list[int]:
    """``maintain.upsert_update`` in the parts of the incoming rows, which hold each key once; returns the parts."""
    touched = table.parts_of(incoming)
    table.rewrite(touched, lambda rows: maintain.upsert_update(rows, incoming, keys, update))
    return touched


def update_from(table: PartedRelation, source: DataFrame, key: str, column: str) -> list[int]:
    """``maintain.update_from`` in the parts where a value is another one now; returns the parts."""
    new = source.select(key, F.col(column).alias("__new"))
    differ = table.read().select(table.key, key, column).join(new, key).where(
        F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column)))
    touched = table.parts_of(differ)
    table.rewrite(touched, lambda rows: maintain.update_from(rows, source, key, column))
    return touched


def delete_rows(table: PartedRelation, gone: DataFrame, column: str, key: str) -> list[int]:
    """Rows whose ``column`` is among the ``key`` values that went leave their parts; returns the parts."""
    touched = table.parts_with(gone, column, key)
    table.rewrite(touched, lambda rows: maintain.without(rows, gone, column, key))
    return touched


def empty_column(table: PartedRelation, gone: DataFrame, column: str, key: str) -> list[int]:
    """``column`` is emptied where it points to a value that went; returns the parts. It can't be the key of the parts."""
    touched = table.parts_with(gone, column, key)
    table.rewrite(touched, lambda rows: maintain.set_null(rows, gone, column, key))
    return touched


def cascade_delete(relations: dict[str, PartedRelation], users: DataFrame, matches: DataFrame) -> dict[str, list[int]]:
    """Users and matches go, with what points to them; returns the parts that were rewritten, by relation."""
    users, matches = users.select("user_id"), matches.select("match_id")
    touched = {
        "picks": delete_rows(relations["picks"], users, "user_id", "user_id")
        + delete_rows(relations["picks"], matches, "match_id", "match_id"),
        "edges": delete_rows(relations["edges"], users, "user_id", "user_id")
        + delete_rows(relations["edges"], users, "friend_id", "user_id"),
        "subscriptions": delete_rows(relations["subscriptions"], users, "user_id", "user_id"),
        "pending": delete_rows(relations["pending"], matches, "match_id", "match_id")
        + empty_column(relations["pending"], users, "assigned_to", "user_id"),
    }
    return {name: sorted(set(parts)) for name, parts in touched.items()}

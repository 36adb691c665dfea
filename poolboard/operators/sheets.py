"""Imported pick sheets: read the marks, list the errors, judge and stage whole sets.

A sheet has one row per match: set_id, row, match_order, gana_local, empate, gana_visitante, old_pick.
``row`` is the place in the sheet; ``match_order`` and the marks are cells as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fill, mark, trimmed
from ..functions.wording import (
    CONTEST_SIZE, OUTCOMES, ROW_MANY_MARKS, ROW_NO_PICK, ROW_UNKNOWN_MATCH, SHEET_ERRORS_HEAD, SHEET_ERRORS_MORE,
    SHEET_ERRORS_SHOWN, SHEET_HEADER, SHEET_WRONG_SIZE)

MARK_COLUMNS = ("gana_local", "empate", "gana_visitante")
#: Cells by the header of an export (``SHEET_HEADER``) and of the older form; fixed values.
EXPORT_COLUMNS = {"#": "match_order", "Gana Local": "gana_local", "Empate": "empate",
                  "Gana Visitante": "gana_visitante", "Pronóstico (1/X/2)": "old_pick"}


def _pick(marked: list[Column], old: Column) -> Column:
    pick = F.when(marked[0], OUTCOMES[0])
    for is_marked, outcome in zip(marked[1:], OUTCOMES[1:], strict=True):
        pick = pick.when(is_marked, outcome)
    return pick.when(old.isin(*OUTCOMES), old)


def from_export(cells: DataFrame) -> DataFrame:
    """A filled-in export (set_id and the columns of its header) as a sheet; rows keep their order within a set's file."""
    def cell(name: str) -> Column:
        return F.col(f"`{name}`") if name in cells.columns else F.lit(None).cast("string")
    return cells.select("set_id", F.monotonically_increasing_id().alias("row"),
                        *[cell(name).alias(column) for name, column in EXPORT_COLUMNS.items()])


def write_filled(filled: DataFrame, path: str) -> None:
    """Filled-in exports (set_id and the columns of the header), many sets to a file: files follow the bytes, not the sets.

    A set's rows lie together in one file, ``set_id`` ahead of the header's columns.
    """
    (filled.select("set_id", *[F.col(f"`{name}`") for name in SHEET_HEADER]).repartition("set_id").write
     .options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))


def read_filled(spark: SparkSession, path: str, set_id_type: str = "string", together: bool = False) -> DataFrame:
    """Filled-in exports below ``path`` as a sheet: a folder ``set_id=...`` for each set, or sets ``together`` in files
    of ``write_filled``."""
    columns, set_id = ", ".join(f"`{name}` string" for name in SHEET_HEADER), f"set_id {set_id_type}"
    schema = f"{set_id}, {columns}" if together else f"{columns}, {set_id}"
    return from_export(spark.read.schema(schema).option("header", True).csv(path))


def sheet_rows(sheet: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Every numbered row with its pick and match, or the error that rejects it.

    The number cell may hold anything: rows without a number, or with zero, are passed over, and a number that is not
    whole names no match.
    """
    number = F.col("match_order").try_cast("double")
    order = F.when(number == F.floor(number), number.try_cast("long"))
    shown = F.coalesce(order.cast("string"), number.cast("string"))
    marked = [mark(c) == "X" for c in MARK_COLUMNS]
    marks = sum(m.cast("int") for m in marked)
    read = sheet.where(number.isNotNull() & ~F.isnan(number) & (number != 0)).select(
        "set_id", "row", order.alias("match_order"), shown.alias("shown"), marks.alias("marks"),
        _pick(marked, mark("old_pick")).alias("pick"))
    known = fixtures.select("match_order", "match_id")
    error = (F.when(F.col("marks") > 1, fill(ROW_MANY_MARKS, "shown"))
             .when(F.col("pick").isNull(), fill(ROW_NO_PICK, "shown"))
             .when(F.col("match_id").isNull(), fill(ROW_UNKNOWN_MATCH, "shown")))
    return read.join(known, "match_order", "left").select(
        "set_id", "row", "match_order", "match_id", F.col("pick").alias("predicted_result"), error.alias("error"))


def sheet_normalise(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull()).drop("error", "row")


def sheet_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNotNull()).select("set_id", "row", "match_order", "error")


def sheet_verdict(rows: DataFrame, size: int = CONTEST_SIZE) -> DataFrame:
    """One row per set: accepted or not, and what to tell its owner.

    Counts combine before the shuffle, and at most the errors shown are gathered.
    """
    counts = rows.groupBy("set_id").agg(
        F.count_if(F.col("error").isNull()).alias("valid_rows"), F.count("error").alias("error_rows"))
    listed = Window.partitionBy("set_id").orderBy("row", "error")
    shown = (sheet_errors(rows).withColumn("n", F.row_number().over(listed))
             .where(F.col("n") <= SHEET_ERRORS_SHOWN).groupBy("set_id")
             .agg(F.array_sort(F.collect_list(F.struct("n", "error"))).alias("shown")))
    more = F.when(F.col("error_rows") > SHEET_ERRORS_SHOWN,
                  fill(SHEET_ERRORS_MORE, F.col("error_rows") - SHEET_ERRORS_SHOWN)).otherwise("")
    message = (F.when(F.col("error_rows") > 0,
                      F.concat(F.lit(SHEET_ERRORS_HEAD), F.array_join("shown.error", "\n"), more))
               .when(F.col("valid_rows") != size, fill(SHEET_WRONG_SIZE, "valid_rows")))
    accepted = (F.col("error_rows") == 0) & (F.col("valid_rows") == size)
    return counts.join(shown, "set_id", "left").select(
        "set_id", "valid_rows", "error_rows", accepted.alias("accepted"), message.alias("message"))


def stage_sets(rows: DataFrame, verdict: DataFrame, labels: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending rows after the accepted sets are added under their trimmed label (set_id, label); a blank label adds none."""
    accepted = verdict.where("accepted").select("set_id")
    staged = sheet_normalise(rows).join(accepted, "set_id", "left_semi").join(
        labels.withColumn("label", trimmed("label")).where("label <> ''"), "set_id").select(
        "label", "match_id", "predicted_result",
        F.lit(None).cast(pending.schema["assigned_to"].dataType).alias("assigned_to"))
    return pending.select(staged.columns).unionByName(staged)

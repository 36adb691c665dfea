"""Changes of stored relations: the same rows as a whole rewrite, and untouched files stay as they are."""

import pytest
from pyspark.sql import functions as F

import contest as c
from poolboard.operators import maintain
from poolboard.sources import parted


@pytest.fixture
def table(spark, tmp_path):
    rows = [(n, n % 7, f"u{n}" if n % 5 else None) for n in range(200)] + [(None, 1, "nobody")]
    return parted.PartedRelation.create(
        spark.createDataFrame(rows, "user_id long, match_id long, name string"), str(tmp_path / "table"), "user_id", 16)


def files(table):
    import pathlib

    return {p.parent.name.split("=")[1]: p.name for p in pathlib.Path(table.path).rglob("*.parquet")}


def held(table):
    return c.rows(table.read())


def changed(before, after):
    return sorted(int(part) for part in before.keys() | after.keys() if before.get(part) != after.get(part))


def test_an_upsert_rewrites_the_folders_of_its_rows(spark, table):
    new = spark.createDataFrame([(3, "three"), (199, None), (1000, "new")], "user_id long, name string")
    wanted, before = c.rows(maintain.upsert_update(table.read(), new, ["user_id"], ["name"])), files(table)
    touched = parted.upsert_update(table, new, ["user_id"], ["name"])
    assert held(table) == wanted and 1 <= len(touched) <= 3
    assert changed(before, files(table)) == touched


def test_an_update_leaves_folders_without_another_value(spark, table):
    source = table.read().select("user_id", F.when(F.col("user_id") == 42, 99).otherwise(F.col("match_id")).alias("match_id"))
    source = spark.createDataFrame(source.collect(), source.schema)
    wanted, before = c.rows(maintain.update_from(table.read(), source, "user_id", "match_id")), files(table)
    touched = parted.update_from(table, source, "user_id", "match_id")
    assert held(table) == wanted and len(touched) == 1 and changed(before, files(table)) == touched
    assert parted.update_from(table, source, "user_id", "match_id") == []


def test_deletes_empty_folders_too_and_repeat_well(spark, table):
    before = files(table)
    part = table.parts_of(spark.createDataFrame([(42,)], "user_id long"))
    there = table.read(part).select("user_id")
    gone = [(r.user_id,) for r in there.collect()]
    keys = spark.createDataFrame(gone, "user_id long")
    wanted = c.rows(maintain.without(table.read(), keys, "user_id", "user_id"))
    assert parted.delete_rows(table, keys, "user_id", "user_id") == part
    assert held(table) == wanted and changed(before, files(table)) == part and str(part[0]) not in files(table)
    assert parted.delete_rows(table, keys, "user_id", "user_id") == [] and held(table) == wanted


def test_a_column_is_emptied_where_it_points_to_what_went(spark, table):
    gone = spark.createDataFrame([(3,)], "match_id long")
    wanted = c.rows(maintain.set_null(table.read(), gone, "match_id", "match_id"))
    parted.empty_column(table, gone, "match_id", "match_id")
    assert held(table) == wanted


def test_a_change_that_fails_leaves_the_table_alone(spark, table):
    before, rows = files(table), held(table)
    with pytest.raises(Exception, match="broken"):
        table.rewrite([1, 2], lambda rows: rows.withColumn("name", F.raise_error(F.lit("broken")).cast("string")))
    assert files(table) == before and held(table) == rows


def test_an_empty_table_and_an_empty_change(spark, tmp_path):
    table = parted.PartedRelation.create(spark.createDataFrame([], "user_id long, name string"), str(tmp_path / "none"), "user_id")
    assert held(table) == []
    parted.upsert_update(table, spark.createDataFrame([(1, "a")], "user_id long, name string"), ["user_id"], ["name"])
    assert held(table) == [(1, "a")]
    assert parted.upsert_update(table, spark.createDataFrame([], "user_id long, name string"), ["user_id"], ["name"]) == []

"""The pipeline stage by stage against plain Python, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from poolboard.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out of it."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.toPandas(), after.toPandas()))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        docs = after
    return out


def test_good_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    before, after = stages[0]
    kept = set(after.doc_id)
    known = labels[labels.doc_id.isin(set(before.doc_id))]
    assert (known.doc_id.isin(kept) == (known.quality == 1)).mean() > 0.97


def test_one_of_each_equal_group_stays(stages):
    before, after = stages[1]
    bare = before.text.fillna("").str.replace(r"[ \t\n\x0b\f\r]", "", regex=True)
    first = before.assign(bare=bare, n=-before.text.fillna("").str.len()).sort_values(["n", "doc_id"])
    assert sorted(after.doc_id) == sorted(first.drop_duplicates("bare").doc_id)


def test_one_of_each_near_group_stays(stages):
    from tests.llm.test_copies import near

    before, after = stages[2]
    groups = near(list(zip(before.doc_id.tolist(), before.text.tolist(), strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted(int(a) for a, _, b in (g[1:-1].split(", ") for g in groups) if a == b)


def test_the_mix_is_as_large_as_its_input(stages):
    before, after = stages[3]
    sizes = [f.text.fillna("").map(lambda t: len(t.encode().split())).sum() for f in (before, after)]
    assert abs(sizes[0] - sizes[1]) <= before.source.nunique()


def test_every_token_is_packed(stages):
    before, after = stages[4]
    assert set(after.doc_id) == set(before.doc_id)
    assert after.groupby("sequence_id").length.sum().max() <= 2048
    assert (after.groupby("sequence_id").length.sum() == after.assign(e=after.offset + after.length)
            .groupby("sequence_id").e.max()).all()


def test_names_and_columns_of_the_queries(spark):
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
    assert set(names) | {"pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, found.select(names).collect()))) == sorted(map(repr, expected.fetchall()))


CLASHES = {"row": "s", "maybe": "m", "node": "n", "key": "k", "size": "z", "__key": "a", "__maybe": "b", "nth": "c", "copies": "d"}


def awkward(spark, stage_docs):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns with the names used inside."""
    from pyspark.sql import functions as F

    good = [r.text for r in stage_docs.orderBy("doc_id").limit(3).collect()]
    long = " ".join(f"w{n % 977}" for n in range(60_000))
    rows = [(None, good[0], "en", "s", 1), (900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, " \n\t", "en", "s", 3),
            (900_004, long, "en", "t", 9), (900_005, "x" * 200_000, "en", "t", 9), (900_006, good[1], "en", "s", 1),
            (900_006, good[1], "en", "s", 1), (900_006, good[2] + " and another ending", "en", None, 1), (None, None, None, None, None)]
    more = stage_docs.select("doc_id", "text", "lang", "source", "n_chars").limit(40).unionByName(
        spark.createDataFrame(rows, stage_docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    return more.select("*", *[F.lit(v).alias(n) for n, v in CLASHES.items()])


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    docs = awkward(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert {tuple(r) for r in after.select(*CLASHES).collect()} <= {tuple(CLASHES.values())}
        assert after.count() > 0, name
        docs = after if n < len(corpus_pipeline.STAGES) - 1 else docs


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name

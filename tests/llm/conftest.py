import pytest


@pytest.fixture
def texts(spark):
    """A frame of (doc_id, text, ...) rows with further columns whose names the operators use inside."""

    def make(rows, **more):
        data = [(i, t, "s", 0, "x", "y") for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, source string, size int, word string, part string")

    return make

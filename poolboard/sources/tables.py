"""Contest relations in files: read with their declared schema, write to a new folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..session import fresh_path

SCHEMAS = {
    "users": schemas.USERS,
    "matches": schemas.FIXTURES,
    "predictions": schemas.PICKS,
    "friendships": schemas.FRIEND_EDGES,
    "pending_predictions": schemas.PENDING,
    "push_subscriptions": schemas.SUBSCRIPTIONS,
    "results_log": schemas.RESULTS_LOG,
}
#: Columns a large relation is laid out by, so that filters on them skip files.
SORTED_BY = {"predictions": "user_id", "pending_predictions": "label", "friendships": "user_id"}


def read_relation(spark: SparkSession, name: str, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """No inference: the schema of the relation is used as it stands (csv files need ``header``)."""
    return spark.read.schema(SCHEMAS[name]).options(**options).format(file_format).load(path)


def write_relation(df: DataFrame, name: str, path: str | None = None, file_format: str = "parquet", **options) -> str:
    """Write to a folder that does not exist yet and return it; readers switch over afterwards.

    Facts are range partitioned and sorted by user or label together with the match, so
    one very busy user still spreads over several files.
    """
    path = path or fresh_path(df.sparkSession, name)
    lead = SORTED_BY.get(name)
    if lead:
        order = [lead] + [c for c in ("match_id", "friend_id") if c in df.columns]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.options(**options).format(file_format).save(path)
    return path

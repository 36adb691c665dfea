"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "poolboard") -> SparkSession:
    """Session for local runs; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_shared_dir(spark)


def _configured(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    return (context.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
            or context.getCheckpointDir())


def ensure_shared_dir(spark: SparkSession) -> SparkSession:
    """For entry points: the context gets the session's ``spark.checkpoint.dir``, a local one without it a new folder.

    A cluster has to name a folder that all its executors share.
    """
    context, folder = spark.sparkContext, _configured(spark)
    if folder is None and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="poolboard-")
    if folder is not None and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables: ``spark.checkpoint.dir``."""
    folder = _configured(spark)
    if folder is None:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; the writer creates it."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")

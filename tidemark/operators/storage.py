"""Results that several parts of a query read: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a session on this machine may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    return folder


def ready(spark: SparkSession) -> str:
    """The session's checkpoint folder, set to the shared one if there is none yet."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written out, so that what reads it again does not compute it again; lost executors lose nothing of it."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)

"""Saving the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    saver(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def unsent(df: DataFrame) -> DataFrame:
    """df with the hint that it be joined by sort-merge.

    Spark sizes what is made from a file, saved rounds too, by the file that it came from: of rows that a small table is
    read or unpacked to it knows nothing, so it would collect tables of any size in the driver to broadcast them.
    """
    return df.hint("merge")


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a round to the session's checkpoint folder, which all executors share, and cuts its lineage.

    Where none is set, a temporary folder is, if driver and executors are one process.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rounds-"))
    return lambda df: df.checkpoint()

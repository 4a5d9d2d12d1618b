"""Where intermediate rows are kept: a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; one of our own only where none is named and all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="leafwork-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def met_by_sort(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables that both grow with the documents. Such tables shuffle to few bytes, and would else be broadcast, several at once, from the driver's memory."""
    return left.join(right.hint("merge"), on, how)

"""Tables between the steps of an iteration, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> None:
    """Names the shared folder to Spark: spark.checkpoint.dir, or one of our own where it is unset, in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if base := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(base)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
    else:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint: what follows neither plans nor, after a loss, computes again what led to them."""
    _shared(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    _shared(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"

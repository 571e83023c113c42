"""Tables and files in the folder that the driver and all executors share.

Lineage is cut by writing a table there, so a lost executor costs a re-read and not a
recomputation of everything before it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where it is unset, in local mode.

    On a cluster a folder of the driver's machine would not be the executors', so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables of one operator call; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
        path = fresh_path(self.spark, f"{self.name}-{what}")
        df.write.parquet(path, compression=codec)
        self.paths[what] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *whats: str) -> None:
        """Delete tables and let Spark's cleaner remove shuffle files that nothing refers to."""
        for w in whats:
            delete_path(self.spark, self.paths.pop(w))
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buckets(spark: SparkSession, texts: DataFrame, column: str = "text", mb_each: int = 48) -> int:
    """Number of exchange buckets so that each holds what ``mb_each`` MB of text yield."""
    from pyspark.sql import functions as F

    n = texts.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]
    return max(shuffle_partitions(spark), int(n // (mb_each << 20)) + 1)

"""Learned tables are computed once: reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and all runs on this machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glyphmill-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint: what comes after neither plans nor computes what came before again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows up to which a settled table of a few short columns is sent to every task.
BROADCAST_ROWS = 200_000


def near_all(settled: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, marked for broadcast if a count shows that it is small; a checkpoint doesn't tell the planner its size."""
    return F.broadcast(settled) if settled.limit(rows + 1).count() <= rows else settled

"""The cluster's shared folder, frames materialised in it, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError

#: Rows of a driver-made lookup table up to which it is broadcast; beyond, Spark joins it by its size.
BROADCAST_ROWS = 100_000


def one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one machine gets a temporary folder and a cluster an error."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if told is None and not one_machine(spark):
            raise ConflictError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return (told or sc.getCheckpointDir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, removed when the session ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that two passes over it see the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table for a join: broadcast while it is small, else left to Spark's own choice."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

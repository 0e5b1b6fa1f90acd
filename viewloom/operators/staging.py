"""Reduced tables that several passes read are written once, to the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; only a local session may go without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="viewloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with the session."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)  # what is there can be marked to go
    files.deleteOnExit(path)
    return f"{folder}/data"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and go on from that table.

    Unlike a checkpoint the table keeps its columns apart and knows its size: later reads
    take only the columns and rows they need, and Spark can choose joins by size. The files
    go when the session's file system closes.
    """
    spark = df.sparkSession
    folder = scratch(spark, "stored")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)

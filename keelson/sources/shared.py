"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a temporary folder in local mode, as in tests, and an error on a
    cluster."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keelson-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint: its rows and their partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder below the shared one; whether it was there."""
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return False
    if not files.rename(at, to):
        raise OSError(f"{source} can't be renamed to {target}")
    return True

"""What a session needs before queries run: Python workers must find this package, and tables a shared folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did; on a cluster ship it with --py-files instead."""
    root, found = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{found}".rstrip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set, a session on this machine alone (as in tests) gets one of its own; a cluster doesn't.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def folder(spark: SparkSession, path: str):
    """A path as Hadoop has it, and its file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath, files = folder(spark, path)
    files.deleteOnExit(jpath)
    return path


#: Rows of a table that may be broadcast.
MOST_BROADCAST = 100_000


def broadcast_if_few(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, marked for a broadcast if it has few rows: they are counted first, and more of them are left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and lost executors cost their own tasks."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

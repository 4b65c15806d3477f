"""The folder that driver and executors share, and cuts of lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set. Elsewhere a new temporary folder,
    but only where driver and executors are one process; a cluster has to name
    its folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="evidentia-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, its lineage cut by a reliable checkpoint (small tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again (large tables). Its
    path is added to made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidentia/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stage() made in a loop and nothing reads any more. The
    JVM is asked for a collection, upon which Spark deletes the files of the
    shuffles that led to them; else they stay for half an hour."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint behind a counted bound; beyond it Spark shuffles. df is
    cheap to count: a small source, or a table in the shared folder."""
    return F.broadcast(df) if df.count() <= most_rows else df

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir; with a local master, where one machine is all there is, in the warehouse if that is unset. It goes when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    return f"{named.rstrip('/')}/ledgerline-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing uses yet."""
    folder = shared_folder(spark)
    files(spark, folder).deleteOnExit(path_of(spark, folder))
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: evaluated once however often it is read, its lineage cut, and lost executors survived."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # keys are half noise, as in snapshots
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what once() wrote, when nothing that is still to run reads it."""
    for df in tables:
        files(df.sparkSession, df._stored_at).delete(path_of(df.sparkSession, df._stored_at), True)


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def files(spark: SparkSession, path: str):
    """The file system that path is in."""
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())

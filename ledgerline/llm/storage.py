"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.shipping import ship_package


#: Bytes of an Arrow batch: rows of texts differ by orders of magnitude, and a task holds a batch several times over.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir; with a local master, where one machine is all there is, in the warehouse if that is unset. It goes when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    return f"{named.rstrip('/')}/ledgerline-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, folder).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(folder))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing that is still to run reads it."""
    for df in tables:
        _files(df.sparkSession, df._stored_at).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at), True)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of BATCH_BYTES at most, unless the application was started with a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return ship_package(spark).read.parquet(f"{sf_dir}/{table}.parquet")

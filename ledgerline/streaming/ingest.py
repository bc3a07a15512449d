"""Structured Streaming forms of the ledger's ingest: a watched folder, idempotent appends, late restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.schemas import FEED_RECORDS
from ledgerline.sources.polls import KEYED, RECORD_KEYS
from ledgerline.sources.snapshots import Store
from ledgerline.sources.statements import GLOB


def watched_folder(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """(path, content) of export files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", GLOB).option("maxFilesPerTrigger", files_a_batch).load(path)


def observed(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(FEED_RECORDS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def without_repeats(stream: DataFrame, late: str = "5 days") -> DataFrame:
    """Observations delivered again within the overlap count once; state older than that is dropped."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(list(RECORD_KEYS))


def append(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Append new observations to feed_records; a batch delivered twice adds nothing. Runs until the input is used up."""

    def one(batch: DataFrame, _: int) -> None:
        Store(batch.sparkSession, store.root).append_new({"feed_records": batch.drop("uid")}, KEYED)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Counts and sums a day and source, final once the watermark has passed."""
    return stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 day"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents")).select(F.col("window.start").alias("day"), "source", "n", "cents")

"""The append-only event log: scan, integrity, and replay into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT = "sha string, kind string, at timestamp, body string, _corrupt_record string"


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): events as JSON lines; unreadable ones are kept apart, not raised."""
    rows = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("sha").isNull() | F.col("kind").isNull()
    return rows.filter(~bad).drop("_corrupt_record"), rows.filter(bad)


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("at", "sha")


def digest(kind: str = "kind", body: str = "body"):
    """An event's name: its kind and body, not its time."""
    return F.sha2(F.concat_ws("\x1f", kind, body), 256)


def integrity(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: readable, unreadable, misnamed."""
    told = good.agg(F.count(F.lit(1)).alias("readable"), F.count_if(F.col("sha") != digest()).alias("misnamed"))
    return told.crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("unreadable")))).select("readable", "unreadable", "misnamed")


def table_of(events: DataFrame, kind: str, schema: StructType | str) -> DataFrame:
    """Events of a kind as rows of its table, repeated ones once."""
    own = events.filter(F.col("kind") == kind).dropDuplicates(["sha"])
    return own.select("sha", "at", F.from_json("body", schema).alias("b")).select("sha", "at", "b.*")


def resolved(children: DataFrame, parents: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(rows whose parent is there, orphans): order of arrival doesn't matter."""
    return children.join(parents, key), children.join(parents, key, "left_anti")

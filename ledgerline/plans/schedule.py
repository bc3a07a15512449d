"""When to poll next: coverage, holes and the next window, derived from the polls that succeeded."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days a request may span, days asked for again, days of history wanted, requests a day.
MAX_SPAN_DAYS, OVERLAP_DAYS, BACKFILL_DAYS, MAX_CALLS_DAY = 89, 5, 400, 20


@dataclass(frozen=True)
class Span:
    start: date
    end: date


def _done(polls: DataFrame) -> DataFrame:
    return polls.filter(F.col("outcome").isin("ok", "partial") & F.col("window_from").isNotNull() & F.col("window_to").isNotNull())


def gaps(polls: DataFrame, by: str = "source", bucket: str = "year") -> DataFrame:
    """(by, gap_from, gap_to): days that no successful poll covered, between the first and the last covered one.

    Windows are first summed to one row a (source, start), and the running end is taken in two levels, within
    a year and over years, so no task holds all windows of one source.
    """
    w = _done(polls).groupBy(by, F.col("window_from").alias("start")).agg(F.max("window_to").alias("end")).withColumn("__y", F.date_trunc(bucket, "start"))
    years = w.groupBy(by, "__y").agg(F.max("end").alias("y_end"))
    before_year = F.max("y_end").over(Window.partitionBy(by).orderBy("__y").rowsBetween(Window.unboundedPreceding, -1))
    years = years.withColumn("__before", before_year).drop("y_end")
    inside = F.max("end").over(Window.partitionBy(by, "__y").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    reach = w.withColumn("__inside", inside).join(years, [by, "__y"]).withColumn("reach", F.greatest("__inside", "__before"))
    return reach.filter(F.col("start") > F.col("reach")).select(by, F.col("reach").alias("gap_from"), F.col("start").alias("gap_to"))


def watermark(polls: DataFrame) -> DataFrame:
    return _done(polls).groupBy("source").agg(F.min("window_from").alias("earliest"), F.max("window_to").alias("watermark"))


def calls_on(polls: DataFrame, day: str) -> DataFrame:
    return polls.groupBy("source").agg(F.count_if(F.to_date("started_at") == F.lit(day).cast("date")).alias("calls"))


def next_window(polls: DataFrame, source: str, today: date) -> Span | None:
    """The next span to ask a source for; None when the day's calls are used up.

    A hole within reach comes first, then the past not yet asked for, then the tail with an overlap. What
    the driver sees is one row of sums and the first reachable hole. Polls without windows count as calls only.
    """
    own = polls.filter(F.col("source") == source)
    used = own.agg(F.count_if(F.to_date("started_at") == F.lit(today)).alias("n")).first()["n"]
    if used >= MAX_CALLS_DAY:
        return None
    end = today + timedelta(days=1)
    floor = end - timedelta(days=MAX_SPAN_DAYS)
    covered = watermark(own).first()
    if covered is None:
        return Span(floor, end)
    reachable = today - timedelta(days=MAX_SPAN_DAYS)
    hole = gaps(own).select(F.greatest("gap_from", F.lit(reachable)).alias("a"), F.least("gap_to", F.lit(today)).alias("b")).filter("a < b").orderBy("a").first()
    if hole is not None:
        return Span(hole["a"], min(hole["b"], hole["a"] + timedelta(days=MAX_SPAN_DAYS)))
    oldest = today - timedelta(days=BACKFILL_DAYS)
    if covered["earliest"] > oldest:
        start = max(covered["earliest"] - timedelta(days=MAX_SPAN_DAYS), oldest, floor)
        if start < covered["earliest"]:
            return Span(start, covered["earliest"])
    return Span(max(min(covered["watermark"], today) - timedelta(days=OVERLAP_DAYS), floor), end)

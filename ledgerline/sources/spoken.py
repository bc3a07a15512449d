"""Receipts that are text from the start: said, typed or forwarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import trimmed


def text_receipts(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(receipts, refused) of (said_at, text), with all other columns kept: body begins with the date and the minute, sha256 names it.

    The body holds the date, since whoever reads it later mustn't take that day for today; the minute keeps equal purchases
    apart. Texts without anything but white space, null ones and those without a time are refused.
    """
    clean = trimmed(F.col("text"))
    rows = said.withColumn("__clean", clean)
    nothing = F.coalesce(F.col("__clean"), F.lit("")) == ""
    body = F.concat(F.lit("Date: "), F.date_format("said_at", "yyyy-MM-dd"), F.lit("\nTime: "), F.date_format("said_at", "HH:mm"), F.lit("\n\n"), F.col("__clean"), F.lit("\n"))
    told = rows.withColumns({"body": body, "sha256": F.sha2(body, 256), "reason": F.when(nothing, "nothing was said").when(F.col("said_at").isNull(), "no time")}).drop("__clean")
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").drop("body", "sha256")

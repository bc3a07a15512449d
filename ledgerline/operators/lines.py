"""Fragments of a page into lines of text, by where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.ordered import RANGE, in_ranges, with_previous, with_sums
from ledgerline.storage import once

#: Fixed value: the share of a fragment's height by which its neighbour's middle may differ within one line.
SHARE = 0.6
#: A page of more fragments is dealt over tasks.
MOST = 1_000_000


def cluster_lines(fragments: DataFrame, page: str = "page", share: float = SHARE, most: int = MOST) -> DataFrame:
    """(page, line_no, fragments, line): lines from top to bottom, each one's fragments from left to right, two spaces between.

    fragments: (page, seq, x, y, h, text), where y is the middle. A line ends where the next fragment's middle is further
    down than `share` of the larger of both heights. Fragments of equal middles come by seq, those of equal left edges by
    middle, then seq. Fragments without y or h are left out, those without a text count as empty ones.
    Only pages of more than `most` fragments are dealt over ranges.
    """
    own = fragments.select(F.col(page).alias("page"), "seq", "x", "y", "h", F.coalesce("text", F.lit("")).alias("text")).filter("y is not null and h is not null")
    large = once(own.groupBy("page").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(F.col("page").alias("__large")), "large-pages")
    if large.isEmpty():
        lines = _in_one(own, share)
    else:
        same, few = F.col("page").eqNullSafe(F.col("__large")), F.broadcast(large)  # one in `most` fragments at most
        lines = _in_one(own.join(few, same, "left_anti"), share).unionByName(_over_ranges(own.join(few, same, "left_semi"), share))
    return lines.select(F.col("page").alias(page), "line_no", "fragments", F.array_join(F.transform("__f", lambda f: f["text"]), "  ").alias("line"))


_ORDER = ["y", "seq"]


def _breaks(share: float) -> Column:
    return F.coalesce((F.abs(F.col("y") - F.col("__y")) > share * F.greatest("h", "__h")).cast("int"), F.lit(0))


def _lines(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("page", "line_no").agg(F.count(F.lit(1)).alias("fragments"), F.array_sort(F.collect_list(F.struct("x", "y", "seq", "text"))).alias("__f"))


def _in_one(own: DataFrame, share: float) -> DataFrame:
    """Each page in one task: fragments are shuffled once, and nothing is written."""
    w = Window.partitionBy("page").orderBy(*_ORDER)
    placed = own.repartition("page").withColumns({"__y": F.lag("y").over(w), "__h": F.lag("h").over(w)}).withColumn("__break", _breaks(share))
    return _lines(placed.withColumn("line_no", F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))))


def _over_ranges(own: DataFrame, share: float) -> DataFrame:
    """Each page over as many tasks as it needs."""
    placed = with_previous(in_ranges(own, ["page"], _ORDER), ["page"], _ORDER, {"__y": F.col("y"), "__h": F.col("h")})
    rows = once(placed.withColumn("__break", _breaks(share)), "fragments")
    return _lines(with_sums(rows, ["page"], _ORDER, {"line_no": F.col("__break")}).drop(RANGE))

"""What has to go for a store to fit its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ordered import RANGE, in_ranges, with_sums


def evicted(files: DataFrame, budget: int, at: str = "at", size: str = "bytes", key: str = "path") -> DataFrame:
    """The rows of files to delete, oldest first, until what is left takes `budget` bytes at most; none if all fit.

    A file goes while the files after and with it take more than the budget. Ties go by size, then key; files without a
    time go first, those without a size take no room.
    """
    order = [at, size, key]
    total = files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("__total"))
    summed = with_sums(in_ranges(files, [], order), [], order, {"__freed": F.col(size)})
    left = F.col("__total") - (F.col("__freed") - F.coalesce(F.col(size), F.lit(0)))
    return summed.crossJoin(F.broadcast(total)).filter(left > budget).drop(RANGE, "__freed", "__total")

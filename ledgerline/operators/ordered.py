"""Running sums and previous rows over an order, without a task that holds all rows of a group.

Rows are dealt into ranges of (group, order), which split a group that is too large for one task; a range's rows are
summed up within it, and over ranges only one row a (group, range) is left to sort. Rows that agree in the whole order
are interchangeable, so an order should end in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.storage import once

RANGE = "__range"


def in_ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with RANGE, a number that grows with (group, order); written once, since ranges come from a sample."""
    return once(df.repartitionByRange(*group, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _window(group: list[str], order: list[str]):
    return Window.partitionBy(*group, RANGE).orderBy(*order)


def _before(group: list[str]):
    """Over the ranges of a group; without a group there is one row a range, and only those meet."""
    return Window.partitionBy(*group).orderBy(RANGE)


def _joined(rows: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    same = F.col(f"r.{RANGE}") == F.col(f"p.{RANGE}")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}"))
    extra = [c for c in per.columns if c not in (*group, RANGE)]
    return rows.alias("r").join(per.alias("p"), same).select("r.*", *[f"p.{c}" for c in extra])


def with_sums(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows (of in_ranges) with running sums up to and with each row; a null adds nothing."""
    values = {name: F.coalesce(c, F.lit(0)) for name, c in sums.items()}
    per = rows.groupBy(*group, RANGE).agg(*[F.sum(v).alias(f"__{n}") for n, v in values.items()])
    earlier = per.select(*group, RANGE, *[F.coalesce(F.sum(f"__{n}").over(_before(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__{n}") for n in values])
    within = _window(group, order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(rows, earlier, group)
    return out.select(*rows.columns, *[(F.sum(v).over(within) + F.col(f"__{n}")).alias(n) for n, v in values.items()])


def with_previous(rows: DataFrame, group: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows (of in_ranges) with values of the row before each in its group, null for the first."""
    held = F.struct(*[v.alias(n) for n, v in values.items()])
    last = rows.groupBy(*group, RANGE).agg(F.max_by(held, F.struct(*order)).alias("__last"))
    earlier = last.select(*group, RANGE, F.lag("__last").over(_before(group)).alias("__earlier"))
    out = _joined(rows, earlier, group).withColumn("__before", F.coalesce(F.lag(held).over(_window(group, order)), F.col("__earlier")))
    return out.select(*rows.columns, *[F.col("__before")[n].alias(n) for n in values])

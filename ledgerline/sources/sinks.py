"""New and changed rows, and published forms; snapshots.Store commits them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.observations import first_of_each, latest_of_each
from ledgerline.schemas import markdown


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of batch whose keys aren't stored yet, each key once, first by order."""
    return first_of_each(batch, keys, order).join(stored.select(*keys), keys, "left_anti").select(*batch.columns)


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """stored with batch's rows in place of theirs."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    return latest_of_each(both, keys, ["__new", *order]).drop("__new")


def write_months(df: DataFrame, path: str, day: str = "date", key: str = "id", as_told: Callable[[DataFrame], DataFrame] = lambda rows: rows, compression: str = "none") -> None:
    """JSON lines in year and month folders, sorted within, keys sorted, nulls kept; undated rows under 0000-00.

    Months are dealt out by ranges of day and key, so one that holds most rows is several files, each sorted and after the last.
    df's own columns are dealt; what as_told adds to them, and the lines, are made where they have arrived.
    """
    month = F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("0000-00"))
    told = as_told(df.repartitionByRange(F.col(day), F.col(key)))
    rows = told.select(F.substring(month, 1, 4).alias("year"), F.substring(month, 6, 2).alias("month"), F.col(day).alias("__d"), F.col(key).alias("__k"), F.struct(*sorted(told.columns)).alias("__row"))
    lines = rows.sortWithinPartitions("year", "month", "__d", "__k").select("year", "month", F.to_json("__row", {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").option("compression", compression).partitionBy("year", "month").text(path)


def broken(df: DataFrame, rule: str) -> DataFrame:
    """Rows that break a rule a table must keep."""
    return df.filter(f"NOT coalesce({rule}, true)")


def manifest(bank: DataFrame, receipts: DataFrame, polls: DataFrame) -> DataFrame:
    """One row: spans and counts by stream, and each source's last success and failure."""
    span = lambda df, n: df.agg(F.min("date").alias(f"{n}_from"), F.max("date").alias(f"{n}_to"), F.count(F.lit(1)).alias(f"{n}_rows"))
    ok = F.when(F.col("outcome").isin("ok", "partial"), F.col("started_at"))
    health = polls.groupBy("source").agg(F.max(ok).alias("last_ok"), F.count(F.lit(1)).alias("polls")).agg(F.sort_array(F.collect_list(F.struct("source", "last_ok", "polls"))).alias("feeds"))
    return span(bank, "bank").crossJoin(F.broadcast(span(receipts, "receipts"))).crossJoin(F.broadcast(health))


def documentation(schemas: dict[str, StructType]) -> str:
    return "\n".join(markdown(n, s) for n, s in schemas.items())


def render(df: DataFrame, as_json: bool = False, most: int | None = None) -> str:
    """A report: an aligned table, or JSON lines; `(no rows)` if empty. With `most`, that many rows, and the table says how many more there are."""
    shown = df if most is None else df.limit(most)
    if as_json:
        return "\n".join(r["value"] for r in shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect())
    rows = [["" if v is None else str(v) for v in r] for r in shown.collect()]
    more = 0 if most is None or len(rows) < most else df.count() - len(rows)
    if not rows and not more:
        return "(no rows)"
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *rows]) + (f"\n({more} more rows)" if more else "")

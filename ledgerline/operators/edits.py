"""Hand edits on their way into the correction tables: what they would change, and the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import to_cents
from ledgerline.schemas import CORRECTIONS, FEED_CORRECTIONS, FEED_FIELDS, RECEIPT_FIELDS, shaped
from ledgerline.sources.snapshots import Keyed, month_of

MONEY = ("subtotal", "tax", "tip", "total")
TEXTS = ("merchant", "merchant_location", "currency", "category")
SCHEMAS = {"corrections": CORRECTIONS, "feed_corrections": FEED_CORRECTIONS}
#: An edit is known by what it says and when; its id tells it from another, so repeating a call adds nothing.
KEYED = {
    "corrections": Keyed(("id",), "id", ("created_at",), month_of("cast(created_at AS string)")),
    "feed_corrections": Keyed(("uid",), "uid", ("created_at",), month_of("cast(created_at AS string)")),
}


def _same(field: Column, value: Column) -> Column:
    """Whether an edit says what is there already: amounts as cents, days as dates, an empty text like none.

    Line items are never the same, nor is an amount that can't be read, nor a field that receipts don't have. A receipt that
    isn't deleted is as one whose mark is empty.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    money = to_cents(value)
    out = F.when(field.isin(*MONEY) & money["reject_reason"].isNotNull(), False)
    for f in MONEY:
        out = out.when(field == f, money["cents"].eqNullSafe(F.col(f"{f}_cents")))
    for f in TEXTS:
        out = out.when(field == f, blank(F.col(f)).eqNullSafe(blank(value)))
    out = out.when(field == "purchased_on", F.col("purchased_on").cast("string").eqNullSafe(blank(value)))
    return out.when(field == "deleted", ~F.col("deleted") & blank(value).isNull()).otherwise(False)


def judged(changes: DataFrame, transactions: DataFrame) -> DataFrame:
    """(receipt_id, field, value, verdict): recorded, unchanged or refused (no such receipt, or no field). An empty value clears.

    Of several edits of a field in one call the last by value stays; repeated ones count once.
    """
    own = changes.select("receipt_id", "field", F.col("value").cast("string").alias("value")).groupBy("receipt_id", "field").agg(F.max("value").alias("value"))
    now = transactions.select("receipt_id", "purchased_on", "deleted", *TEXTS, *[f"{f}_cents" for f in MONEY], F.lit(True).alias("__there"))
    rows = own.join(now, "receipt_id", "left")
    known = F.col("field").isin(*RECEIPT_FIELDS) | F.col("field").startswith("item.")
    verdict = F.when(F.col("__there").isNull() | ~F.coalesce(known, F.lit(False)), "refused").when(_same(F.col("field"), F.col("value")), "unchanged").otherwise("recorded")
    return rows.select("receipt_id", "field", F.nullif("value", F.lit("")).alias("value"), verdict.alias("verdict"))


def as_corrections(rows: DataFrame, at: str) -> DataFrame:
    """judged() edits to record, as rows of the correction table made at an instant."""
    made = rows.filter("verdict = 'recorded'").withColumn("created_at", F.lit(at).cast("timestamp"))
    return shaped(made.withColumn("id", F.xxhash64("receipt_id", "field", F.coalesce("value", F.lit("\0")), "created_at")), CORRECTIONS)


def as_feed_corrections(changes: DataFrame, at: str) -> DataFrame:
    """Edits (txn_key, field, value) of fields that may be edited, as rows of the feed's correction table."""
    made = changes.filter(F.col("txn_key").isNotNull() & F.col("field").isin(*FEED_FIELDS)).withColumns({"created_at": F.lit(at).cast("timestamp"), "value": F.nullif(F.col("value").cast("string"), F.lit(""))})
    return shaped(made.withColumn("uid", F.sha2(F.concat_ws("\x1f", "txn_key", "field", F.coalesce("value", F.lit("\0")), F.col("created_at").cast("string")), 256)), FEED_CORRECTIONS)

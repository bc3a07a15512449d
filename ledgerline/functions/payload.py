"""JSON payloads: receipts as extracted, and sources' error lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.dates import iso_date

#: The categories a receipt may have.
CATEGORIES = ("groceries", "restaurant", "transport", "fuel", "pharmacy", "household", "entertainment", "clothing", "services", "other")
RECEIPT = "merchant string, merchant_location string, purchased_on string, currency string, subtotal string, tax string, tip string, total string, category string, line_items array<struct<description:string,qty:string,unit_price:string,total:string>>"
ERRORS = "array<struct<code:string,msg:string,account_id:string,conn_id:string>>"


def receipt(payload: Column) -> Column:
    """The payload as a struct: unknown dates absent, currency three capitals (USD by default), unknown categories dropped."""
    raw = F.from_json(payload, RECEIPT)
    category = F.lower(F.trim(raw["category"]))
    return F.struct(
        raw["merchant"].alias("merchant"),
        raw["merchant_location"].alias("merchant_location"),
        iso_date(raw["purchased_on"]).alias("purchased_on"),
        F.substring(F.upper(F.trim(F.coalesce(F.nullif(raw["currency"], F.lit("")), F.lit("USD")))), 1, 3).alias("currency"),
        *[raw[x].alias(x) for x in ("subtotal", "tax", "tip", "total")],
        F.when(category.isin(*CATEGORIES), category).alias("category"),
        F.coalesce(raw["line_items"], F.array()).alias("line_items"),
    )


def needs_a_human(errors: Column) -> Column:
    """Whether a source's error list has a broken connection in it."""
    return F.coalesce(F.exists(F.from_json(errors, ERRORS), lambda e: e["code"].startswith("con.")), F.lit(False))


def sorted_json(*columns: str) -> Column:
    """One JSON object with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})

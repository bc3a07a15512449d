"""The published tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_key
from ledgerline.functions.money import amount_string
from ledgerline.functions.text import merchant_key, merchant_name
from ledgerline.rules import Rules
from ledgerline.schemas import BANK, OUTGO, RECEIPT_LEDGER, shaped


def bank(feed: DataFrame) -> DataFrame:
    """Feed transactions as published; deleted ones are left out."""
    renamed = feed.filter(~F.col("deleted")).withColumnsRenamed({"txn_key": "id", "dated_on": "date", "account_key": "account", "kind": "account_kind"})
    return shaped(renamed.withColumns({"stream": F.lit("bank"), "amount": amount_string(F.col("amount_cents"))}), BANK)


def receipts(transactions: DataFrame, rules: Rules, base_url: str = "") -> DataFrame:
    """Receipt transactions as published: same merchants as the bank's, a measure that is always 0."""
    name = merchant_name(F.col("merchant"), rules.merchants.match_spaced(F.col("merchant")))
    out = transactions.filter(~F.col("deleted")).withColumns({"merchant_raw": F.col("merchant"), "merchant": name})
    out = out.withColumns({"id": F.concat(F.lit("receipt:"), F.col("receipt_id").cast("string")), "stream": F.lit("receipt"), "date": F.col("purchased_on"), "merchant_key": merchant_key(F.col("merchant")), "flow": F.lit(OUTGO), "net_cost_cents": F.lit(0), "receipt_url": F.concat(F.lit(f"{base_url}/r/"), F.col("receipt_id").cast("string"))})
    return shaped(out, RECEIPT_LEDGER)


def match_struct(bank_rows: DataFrame) -> DataFrame:
    """bank with what the other stream is compared on, as one nested column."""
    return bank_rows.withColumn("match", F.struct("date", "amount_cents", "merchant_key"))


def costs(bank_rows: DataFrame) -> DataFrame:
    return bank_rows.filter("counts_as_cost")


def monthly(bank_rows: DataFrame) -> DataFrame:
    return costs(bank_rows).groupBy(month_key(F.col("date")).alias("month"), F.coalesce("category", F.lit("uncategorised")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("net_cost_cents").alias("cents"))


def everything(bank_rows: DataFrame, receipt_rows: DataFrame) -> DataFrame:
    """Both streams; net_cost_cents may still be summed."""
    common = ["id", "stream", "date", "merchant", "merchant_key", "category", "flow", "currency", "net_cost_cents", "status"]
    return bank_rows.select(*common).unionByName(receipt_rows.select(*common))


def register(bank_rows: DataFrame, receipt_rows: DataFrame, accounts: DataFrame | None = None, items: DataFrame | None = None, polls: DataFrame | None = None) -> None:
    """Temporary views for SQL."""
    views = {"bank": bank_rows, "receipts": receipt_rows, "costs": costs(bank_rows), "monthly": monthly(bank_rows), "everything": everything(bank_rows, receipt_rows), "accounts": accounts, "items": items, "feed_polls": polls}
    for name, df in views.items():
        if df is not None:
            df.createOrReplaceTempView(name)

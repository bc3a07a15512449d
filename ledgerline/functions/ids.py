"""Identities by content."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

UNIT = "\x1f"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT, *parts), 256)


def txn_key(source: Column, native_account: Column, external_id: Column) -> Column:
    """One transaction's identity, whatever account it is named under."""
    return F.substring(_digest(source, native_account, external_id), 1, 24)


def digest_of(*columns: str) -> Column:
    """A hash over the named columns, nulls told from empty texts, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def content_hash() -> Column:
    """A record's revision: the fields a bank may restate."""
    return digest_of("posted_at", "transacted_at", "amount_cents", "description", "payee", "memo", "pending")


def account_hash() -> Column:
    return digest_of("name", "org_name", "currency", "balance_cents", "available_balance_cents", "balance_at")


def synthesised_id(order: Column, *within: str) -> Column:
    """An id for sources that have none: content, and a number among otherwise equal rows of one file.

    Expects native_account, posted_at, amount_cents and description; within: columns that part files.
    """
    group = [*within, "native_account", F.coalesce("posted_at", F.lit("")), "amount_cents", "description"]
    ordinal = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    amount = F.coalesce(F.col("amount_cents").cast("string"), F.lit("None"))
    return F.substring(_digest(F.col("native_account"), F.coalesce(F.col("posted_at"), F.lit("")), amount, F.col("description"), ordinal.cast("string")), 1, 24)

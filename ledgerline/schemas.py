"""Table schemas, with what each column means and whether it may be summed without a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed values.
OUTGO = "spend"
FLOWS = (OUTGO, "refund", "fee", "income", "transfer", "payment", "unknown")
COST_FLOWS = (OUTGO, "refund", "fee")
OUTCOMES = ("ok", "partial", "error")
STATUSES = ("ok", "pending", "needs_review", "ignored", "failed")
FEED_FIELDS = ("merchant", "category", "flow", "note", "deleted")
RECEIPT_FIELDS = ("merchant", "merchant_location", "currency", "purchased_on", "subtotal", "tax", "tip", "total", "category", "deleted")

_TYPES = {"s": T.StringType(), "l": T.LongType(), "b": T.BooleanType(), "d": T.DateType(), "t": T.TimestampType(), "i": T.IntegerType()}


def table(*columns: tuple[str, str] | tuple[str, str, str] | tuple[str, str, str, bool]) -> T.StructType:
    """(name, type letter, comment, summable) each."""
    return T.StructType([T.StructField(c[0], _TYPES[c[1]], True, {"comment": c[2] if len(c) > 2 else "", "summable": len(c) > 3 and bool(c[3])}) for c in columns])


FEED_RECORDS = table(("uid", "s"), ("source", "s"), ("native_account", "s"), ("external_id", "s"), ("content_sha256", "s"), ("posted_at", "s", "a bare date or an instant"), ("transacted_at", "s", "a bare date or an instant"), ("pending", "b"), ("amount_cents", "l"), ("currency", "s"), ("description", "s"), ("payee", "s"), ("memo", "s"), ("flow_hint", "s"), ("reject_reason", "s"), ("observed_at", "t"), ("poll_uid", "s"))
FEED_CORRECTIONS = table(("uid", "s"), ("txn_key", "s"), ("field", "s"), ("value", "s", "null clears"), ("created_at", "t"))
FEED_ACCOUNTS = table(("uid", "s"), ("source", "s"), ("native_id", "s"), ("name", "s"), ("org_name", "s"), ("currency", "s"), ("balance_cents", "l"), ("available_balance_cents", "l"), ("balance_at", "t"), ("observed_at", "t"))
FEED_POLLS = table(("uid", "s"), ("source", "s"), ("outcome", "s"), ("started_at", "t"), ("window_from", "d"), ("window_to", "d"), ("note", "s"), ("errors", "s"), ("file_sha256", "s"))
RECEIPTS = table(("receipt_id", "l"), ("sha256", "s"), ("source", "s"), ("ingested_at", "t"))
EXTRACTIONS = table(("id", "l"), ("receipt_id", "l"), ("status", "s"), ("payload", "s"), ("note", "s"), ("created_at", "t"))
CORRECTIONS = table(("id", "l"), ("receipt_id", "l"), ("field", "s"), ("value", "s", "null clears"), ("created_at", "t"))
EVENTS = table(("sha", "s"), ("kind", "s"), ("at", "t"), ("body", "s"), ("corrupt", "s"))

BANK = table(
    ("id", "s", "stable across rebuilds"), ("stream", "s", "always bank"), ("date", "d", "local calendar date; group by this one"), ("posted_on", "d", "null while pending"), ("transacted_on", "d"), ("pending", "b", "the amount can still change"),
    ("account", "s"), ("account_name", "s"), ("account_kind", "s"), ("institution", "s"), ("source", "s"), ("description", "s", "verbatim"), ("merchant", "s"), ("merchant_key", "s", "joins to receipts"), ("category", "s"), ("flow", "s"),
    ("amount_cents", "l", "signed; negative left the account; not to be summed"), ("outflow_cents", "l", "counts card payments twice", True), ("inflow_cents", "l", "", True), ("net_cost_cents", "l", "the one to sum", True), ("amount", "s", "display only"),
    ("currency", "s"), ("counts_as_cost", "b"), ("status", "s"), ("review_reason", "s"), ("revisions", "l"), ("amount_changed", "b"), ("duplicate_suspect", "b"), ("external_id", "s"), ("first_seen_at", "t"), ("last_seen_at", "t"),
)
RECEIPT_LEDGER = table(
    ("id", "s", "receipt:<n>"), ("stream", "s", "always receipt"), ("receipt_id", "l"), ("date", "d"), ("merchant", "s"), ("merchant_raw", "s"), ("merchant_key", "s", "joins to bank"), ("category", "s"), ("flow", "s", f"always {OUTGO}"), ("total_cents", "l", "positive; of receipts only"),
    ("subtotal_cents", "l"), ("tax_cents", "l"), ("tip_cents", "l"), ("currency", "s"), ("net_cost_cents", "l", "always 0, so that sums over all streams hold", True), ("status", "s"), ("review_reason", "s"), ("receipt_url", "s"),
)


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with schema's columns, types and comments, in its order; absent columns are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields])


def unsafe_sums(schema: T.StructType, summed: list[str]) -> list[str]:
    """Which of the summed columns must not be summed without a filter."""
    flags = {f.name: f.metadata.get("summable", False) for f in schema.fields if "summable" in f.metadata}
    return [c for c in summed if not flags.get(c, True)]


def markdown(name: str, schema: T.StructType) -> str:
    """The schema's documentation as a table."""
    lines = [f"## {name}", "", "| column | type | summable | note |", "|---|---|---|---|"]
    lines += [f"| {f.name} | {f.dataType.simpleString()} | {'yes' if f.metadata.get('summable') else ''} | {f.metadata.get('comment', '')} |" for f in schema.fields]
    return "\n".join(lines) + "\n"

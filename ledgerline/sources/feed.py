"""Feed payloads: nested accounts and transactions, amounts as text so that nothing passes through floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import unix_instant
from ledgerline.functions.ids import account_hash, content_hash
from ledgerline.functions.money import to_cents

ACCOUNT_SET = (
    "errlist array<struct<code:string,msg:string,account_id:string,conn_id:string>>, accounts array<struct<id:string,name:string,currency:string,balance:string,`available-balance`:string,`balance-date`:bigint,"
    "org:struct<name:string,domain:string,id:string>,transactions:array<struct<id:string,posted:bigint,transacted_at:bigint,amount:string,description:string,payee:string,memo:string,pending:boolean>>>>"
)


def parse(polls: DataFrame, body: str = "body") -> DataFrame:
    """polls with the payload parsed as `set`."""
    return polls.withColumn("set", F.from_json(body, ACCOUNT_SET, {"primitivesAsString": "false"}))


def _instant(seconds: Column) -> Column:
    return F.date_format(unix_instant(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def accounts(parsed: DataFrame) -> DataFrame:
    """One row an account of each poll: poll_uid, source, observed_at and the account's fields."""
    a = parsed.select("poll_uid", "source", "observed_at", F.explode("set.accounts").alias("a"))
    out = a.select("poll_uid", "source", "observed_at", F.col("a.id").alias("native_id"), "a.name", F.col("a.org.name").alias("org_name"), F.coalesce("a.currency", F.lit("USD")).alias("currency"), to_cents(F.col("a.balance"))["cents"].alias("balance_cents"), to_cents(F.col("a.`available-balance`"))["cents"].alias("available_balance_cents"), unix_instant(F.col("a.`balance-date`")).alias("balance_at"))
    return out.withColumn("content_sha256", account_hash()).withColumn("uid", F.sha2(F.concat_ws("\x1f", "source", "native_id", "content_sha256"), 256))


def records(parsed: DataFrame) -> DataFrame:
    """One row a transaction of each poll; rows without an id are dropped; not yet posted means pending."""
    t = parsed.select("poll_uid", "source", "observed_at", F.explode("set.accounts").alias("a")).select("poll_uid", "source", "observed_at", F.col("a.id").alias("native_account"), F.coalesce("a.currency", F.lit("USD")).alias("currency"), F.explode("a.transactions").alias("t"))
    money, posted = to_cents(F.col("t.amount")), _instant(F.col("t.posted"))
    out = t.filter(F.coalesce("t.id", F.lit("")) != "").select(
        "poll_uid", "source", "observed_at", "native_account", "currency", F.col("t.id").alias("external_id"), posted.alias("posted_at"), _instant(F.col("t.transacted_at")).alias("transacted_at"), (F.coalesce("t.pending", F.lit(False)) | posted.isNull()).alias("pending"),
        money["cents"].alias("amount_cents"), money["reject_reason"].alias("reject_reason"), F.coalesce("t.description", F.lit("")).alias("description"), F.nullif("t.payee", F.lit("")).alias("payee"), F.nullif("t.memo", F.lit("")).alias("memo"), F.lit(None).cast("string").alias("flow_hint"),
    )
    out = out.withColumn("content_sha256", content_hash())
    return out.withColumn("uid", F.sha2(F.concat_ws("\x1f", "source", "native_account", "external_id", "content_sha256"), 256))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.select("poll_uid", "source", F.explode("set.errlist").alias("e")).select("poll_uid", "source", "e.*")

"""Statement exports: CSV dialects and OFX, as records with the bank's sign convention.

Files are read as rows of whole text or lines; what can't be read becomes a row of errors, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import parse_date
from ledgerline.functions.ids import content_hash, synthesised_id
from ledgerline.functions.money import to_cents
from ledgerline.functions.text import last_four

GLOB = "*.{csv,ofx,qfx,txt}"
FIELDS = ("native_account", "external_id", "posted_at", "transacted_at", "description", "payee", "memo", "flow_hint", "amount_cents", "reject_reason")


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def _day(name: str) -> Column:
    return parse_date(F.col(f"`{name}`")).cast("string")


def _signed(cents: Column, minus: Column) -> Column:
    return F.when(minus, -F.abs(cents)).otherwise(F.abs(cents))


def _split_columns(money: Column) -> dict[str, Column]:
    return {"native_account": F.concat(F.lit("drop:capitalone-credit:"), last_four(F.col("`Card No.`"), "card")), "posted_at": _day("Posted Date"), "transacted_at": _day("Transaction Date"), "description": _text("Description"), "amount_cents": _signed(money["cents"], _text("Debit") != ""), "reject_reason": money["reject_reason"]}


def _typed_rows(money: Column) -> dict[str, Column]:
    return {"native_account": F.concat(F.lit("drop:capitalone-checking:"), last_four(F.col("`Account Number`"), "acct")), "posted_at": _day("Transaction Date"), "transacted_at": _day("Transaction Date"), "description": _text("Transaction Description"), "amount_cents": _signed(money["cents"], F.lower(_text("Transaction Type")).startswith("debit")), "reject_reason": money["reject_reason"]}


def _inverted_card(money: Column) -> dict[str, Column]:
    kind = F.lower(_text("Type"))
    return {"native_account": F.lit("drop:applecard:apple-card"), "posted_at": _day("Clearing Date"), "transacted_at": _day("Transaction Date"), "description": _text("Description"), "payee": F.nullif(_text("Merchant"), F.lit("")), "flow_hint": F.when(kind == "payment", "payment"), "amount_cents": _signed(money["cents"], kind != "payment"), "reject_reason": money["reject_reason"]}


#: Format names, the header columns that tell them, and the columns they may also have.
DIALECTS: tuple[tuple[str, tuple[str, ...], tuple[str, ...], Callable[[Column], dict[str, Column]]], ...] = (
    ("capitalone-credit", ("Transaction Date", "Posted Date", "Description", "Debit", "Credit"), ("Card No.",), _split_columns),
    ("capitalone-checking", ("Transaction Date", "Transaction Amount", "Transaction Type", "Transaction Description"), ("Account Number",), _typed_rows),
    ("applecard", ("Transaction Date", "Clearing Date", "Merchant", "Amount (USD)"), ("Description", "Type"), _inverted_card),
)

#: Each dialect's amount as it is written; what to_cents() makes of it is handed to its columns.
AMOUNTS: dict[str, Callable[[], Column]] = {
    "capitalone-credit": lambda: F.coalesce(F.nullif(F.col("Debit"), F.lit("")), F.col("Credit")),
    "capitalone-checking": lambda: F.col("`Transaction Amount`"),
    "applecard": lambda: F.col("`Amount (USD)`"),
}


class UnknownFormat(ValueError):
    """No dialect claims the header."""


def sniff(header: list[str]) -> str:
    """The first dialect whose columns are all there."""
    have = {h.strip() for h in header}
    for name, required, _, _ in DIALECTS:
        if have.issuperset(required):
            return name
    raise UnknownFormat(f"no dialect claims these columns: {', '.join(sorted(have))}")


def project(rows: DataFrame, dialect: str) -> DataFrame:
    """FIELDS of raw CSV rows (all columns text) of a dialect; rows without any value are skipped; file and line order kept if there."""
    _, required, optional, columns = next(d for d in DIALECTS if d[0] == dialect)
    for c in (*required, *optional):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    named = [c for c in rows.columns if c not in ("file", "line")]
    filled = rows.filter(F.concat(*[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in named]) != "")
    made = columns(to_cents(AMOUNTS[dialect]()))
    keep = [c for c in ("file", "line") if c in rows.columns]
    return filled.select(*keep, *[made.get(f, F.lit(None)).cast("bigint" if f == "amount_cents" else "string").alias(f) for f in FIELDS])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS with file and line of the CSV files under path that share one header."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", True).option("escape", "\"").option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    dialect = sniff(rows.columns)
    placed = rows.select("*", F.col("_metadata.file_name").alias("file")).withColumn("line", F.monotonically_increasing_id())
    return project(placed, dialect)


def _tag(block: Column, tag: str) -> Column:
    """A tag's text, empty if there is none."""
    return F.trim(F.regexp_extract(block, rf"(?i)<{tag}>\s*([^<\r\n]*)", 1))


def looks_like_ofx(text: Column) -> Column:
    head = F.upper(F.substring(F.ltrim(text), 1, 200))
    return head.contains("OFXHEADER") | head.contains("<OFX")


def parse_ofx(files: DataFrame) -> DataFrame:
    """FIELDS with file and line of whole OFX texts: (file, value)."""
    account = F.when(F.col("value").rlike(r"(?i)<ACCTID>\s*[^\s<]"), F.regexp_extract("value", r"(?i)<ACCTID>\s*([^\s<]+)", 1))
    # the account first: beside exploded blocks, each of them would carry the whole text
    read = files.select("file", F.concat(F.lit("drop:ofx:"), last_four(account, "ofx")).alias("native_account"), F.regexp_extract_all("value", F.lit(r"(?is)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1)).alias("blocks"))
    blocks = read.select("file", "native_account", F.posexplode("blocks").alias("line", "block"))
    tags = blocks.select("file", "line", "native_account", *[_tag(F.col("block"), t).alias(t) for t in ("FITID", "TRNAMT", "DTPOSTED", "DTUSER", "NAME")], F.when(F.col("block").rlike("(?i)<MEMO>"), _tag(F.col("block"), "MEMO")).alias("MEMO"))
    read = tags.withColumns({"__money": to_cents(F.col("TRNAMT")), "__posted": parse_date(F.col("DTPOSTED")).cast("string")})  # once for all that they are read for
    return read.select(
        "file", "line", "native_account", F.nullif("FITID", F.lit("")).alias("external_id"), F.col("__posted").alias("posted_at"), F.coalesce(parse_date(F.col("DTUSER")).cast("string"), "__posted").alias("transacted_at"),
        F.coalesce(F.nullif("NAME", F.lit("")), "MEMO", F.lit("")).alias("description"), F.lit(None).cast("string").alias("payee"), F.col("MEMO").alias("memo"), F.lit(None).cast("string").alias("flow_hint"), F.col("__money.cents").alias("amount_cents"), F.col("__money.reject_reason").alias("reject_reason"),
    )


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").filter(looks_like_ofx(F.col("value")))
    return parse_ofx(files)


def records(parsed: DataFrame, observed_at: Column) -> DataFrame:
    """Feed records: ids synthesised where the source has none, content hashed, not pending."""
    made = synthesised_id(F.col("line"), *(["file"] if "file" in parsed.columns else []))
    out = parsed.withColumns({"external_id": F.coalesce("external_id", made), "pending": F.lit(False), "currency": F.lit("USD"), "source": F.lit("drop"), "observed_at": observed_at})
    out = out.withColumn("content_sha256", content_hash())
    return out.withColumn("uid", F.sha2(F.concat_ws("\x1f", "source", "native_account", "external_id", "content_sha256"), 256))


def outcomes(parsed: DataFrame) -> DataFrame:
    """(file, outcome, rows, bad): partial if an amount couldn't be read."""
    bad = F.count_if(F.col("amount_cents").isNull())
    return parsed.groupBy("file").agg(F.when(bad > 0, "partial").otherwise("ok").alias("outcome"), F.count(F.lit(1)).alias("rows"), bad.alias("bad"))


def unclaimed(spark: SparkSession, path: str, claimed: DataFrame) -> DataFrame:
    """(path, file_sha256) of export files whose content isn't among claimed.file_sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path).select("path", F.sha2("content", 256).alias("file_sha256"))
    return files.join(claimed.select("file_sha256"), "file_sha256", "left_anti").select("path", "file_sha256").orderBy("path")

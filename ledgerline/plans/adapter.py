"""Star-schema tables seen as a ledger, so that every projection and report can run on them.

Line items are bank observations (an order's line met again is a restatement), orders are receipts, customer
events are polls. Everything is a function of the rows, with no clock and no randomness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import rules as rule_files
from ledgerline.functions.ids import content_hash, txn_key
from ledgerline.rules import Accounts, Ordered, Rules

AS_OF = "2001-08-01"
PREFIXES = ("SQ *", "TST* ", "POS DEBIT 09/12 ", "", "ACH PMT ", "PAYPAL *", "CHECKCARD 09/12 ")
ACCOUNTS = tuple((f"account-{i}", {"name": f"Account {i}", "kind": ("checking", "savings", "credit")[min(i, 2)], "institution": "First Bank" if i < 3 else "Second Bank", "native": [f"ACT-{i}"]}) for i in range(6))


#: What the tables' parts are called, as further fragments of the shipped categories.
PART_WORDS = {"groceries": "widget", "transport": "gear", "household": ("anvil", "bolt"), "entertainment": "gizmo", "clothing": "ring"}


def rules() -> Rules:
    base = rule_files.load(tz="UTC")
    words = {k: (w,) if isinstance(w, str) else w for k, w in PART_WORDS.items()}
    categories = Ordered(tuple((label, fragments + words.get(label, ())) for label, fragments in base.categories.entries))
    return Rules(categories, base.merchants, base.flows, Accounts(ACCOUNTS), "UTC")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Line items as bank observations.

    dealt: with txn_key, and all of a transaction in one partition, for the operators that need it so (observations.by_transaction).
    The tables' own columns are moved for it; the longer texts and digests made of them are made where they have arrived.
    """
    # in hundredths before the joins, as these take half of the room that doubles do
    hundredths = lambda c: F.round(F.col(c) * 100).cast("bigint")
    numbers = [hundredths(c).alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *numbers, "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    cents = F.col("l_extendedprice")
    unread = F.col("l_orderkey") % 67 == 0
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("l_linenumber") % len(PREFIXES)).cast("int") + 1)
    source = F.when(F.col("l_orderkey") % 2 == 0, "simplefin").otherwise("drop")
    account = F.concat(F.lit("ACT-"), (F.col("o_custkey") % 7).cast("string"))
    external_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    key = txn_key(source, account, external_id)
    if dealt:
        rows = rows.repartition(key)
    rows = rows.select(
        source.alias("source"),
        account.alias("native_account"),
        external_id.alias("external_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("posted_at"),
        F.when(F.col("l_linenumber") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("transacted_at"),
        (F.col("l_linestatus") == "O").alias("pending"),
        F.when(~unread, F.when(F.col("l_returnflag") == "R", cents).otherwise(-cents)).alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.concat(prefix, F.upper("p_name"), F.lit(" #"), F.col("l_suppkey").cast("string")).alias("description"),
        F.when(F.col("l_orderkey") % 53 == 0, "Direct Payee").when(F.col("l_orderkey") % 59 == 0, "").alias("payee"),
        F.when(F.col("l_orderkey") % 59 == 0, "by mail").alias("memo"),
        F.when(F.col("l_orderkey") % 61 == 0, "transfer").when(F.col("l_orderkey") % 71 == 0, "").alias("flow_hint"),
        F.when(unread, "not an amount: '?'").alias("reject_reason"),
        F.lit(None).cast("string").alias("poll_uid"),
        F.col("l_shipdate").alias("observed_at"),
        F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey", cents, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"), 256).alias("uid"),
        *([key.alias("txn_key")] if dealt else []),
    )
    return rows.withColumn("content_sha256", content_hash())


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand edits of some transactions: a category set or cleared, a merchant, a flow (known or not), a deletion."""
    r = records(spark, sf_dir).select("source", "native_account", "external_id").distinct().withColumn("n", F.substring_index("external_id", "-", 1).cast("bigint"))
    key = txn_key(F.col("source"), F.col("native_account"), F.col("external_id")).alias("txn_key")
    field = F.when(F.col("n") % 101 == 0, "deleted").when(F.col("n") % 37 == 0, "category").when(F.col("n") % 41 == 0, "merchant").when(F.col("n") % 43 == 0, "flow")
    value = F.when(F.col("n") % 101 == 0, "1").when((F.col("n") % 37 == 0) & (F.col("n") % 2 == 0), "services").when((F.col("n") % 37 != 0) & (F.col("n") % 41 == 0), "Corner Shop").when((F.col("n") % 37 != 0) & (F.col("n") % 43 == 0), F.when(F.col("n") % 2 == 0, "fee").otherwise("nonsense"))
    at = F.lit("2001-01-01").cast("timestamp")
    return r.select(key, field.alias("field"), value.alias("value"), at.alias("created_at"), F.lit("a").alias("uid")).filter("field is not null")


def account_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's balance as an observation of one of seven accounts."""
    c = read(spark, sf_dir, "customer")
    return c.select(
        F.format_string("%012d", "c_custkey").alias("uid"), F.when(F.col("c_custkey") % 2 == 0, "simplefin").otherwise("drop").alias("source"), F.concat(F.lit("ACT-"), (F.col("c_custkey") % 7).cast("string")).alias("native_id"), F.col("c_mktsegment").alias("name"), F.lit("Bank").alias("org_name"), F.lit("USD").alias("currency"),
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("balance_cents"), F.timestamp_seconds(F.lit(978307200) + F.col("c_custkey") * 60).alias("balance_at"), F.timestamp_seconds(F.lit(978307200) + F.col("c_custkey") * 60).alias("observed_at"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.format_string("%012d", "event_id").alias("uid"), F.concat(F.lit("source-"), (F.col("user_id") % 5).cast("string")).alias("source"), F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 11 == 0, "partial").otherwise("ok").alias("outcome"), F.col("ts").alias("started_at"),
        F.when(F.col("user_id") % 5 != 4, day).when(F.dayofmonth("ts") % 7 < 3, day).alias("window_from"), F.when(F.col("user_id") % 5 != 4, F.date_add(day, 1)).when(F.dayofmonth("ts") % 7 < 3, F.date_add(day, 1)).alias("window_to"),
        F.col("event_type").alias("note"), F.when(F.col("event_id") % 97 == 0, F.lit('[{"code":"con.auth","msg":"sign in again"}]')).otherwise(F.lit("[]")).alias("errors"), F.sha2("props", 256).alias("file_sha256"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.lit("upload").alias("source"), F.col("o_orderdate").alias("ingested_at"))


def extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extracted receipts: the total as text, up to all lines as items, some attempts failed, some orders not tried."""
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 13 != 0)
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_name")
    money = lambda c: F.concat((c / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    items = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("p_name").alias("description"), F.col("l_quantity").cast("bigint").cast("string").alias("qty"), money(cents).alias("total")))).alias("line_items"), F.min("p_name").alias("merchant"))
    rows = orders.join(items, orders["o_orderkey"] == items["l_orderkey"], "left")
    total = F.round(F.col("o_totalprice") * 100).cast("bigint")
    payload = F.to_json(F.struct("merchant", F.date_format("o_orderdate", "yyyy-MM-dd").alias("purchased_on"), F.lit("usd").alias("currency"), money(total).alias("total"), F.lit("services").alias("category"), "line_items"))
    failed = F.col("o_orderkey") % 29 == 0
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("receipt_id"), F.when(failed, "error").otherwise("ok").alias("status"), F.when(~failed, payload).alias("payload"), F.when(failed, "timeout").alias("note"), F.col("o_orderdate").alias("created_at"))


def receipt_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    field = F.when(F.col("o_orderkey") % 31 == 0, "category").when(F.col("o_orderkey") % 43 == 0, "item.1.description").when(F.col("o_orderkey") % 47 == 0, "total")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("receipt_id"), field.alias("field"), F.when((F.col("o_orderkey") % 31 != 0) & (F.col("o_orderkey") % 43 != 0), "12.345").alias("value"), F.col("o_orderdate").alias("created_at")).filter("field is not null")

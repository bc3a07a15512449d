"""Queries of what comes in and goes out: exports, polls, commits, streams and published files, made of the driver's tables.

Each writes its input to the shared folder first, as files that grow with the tables, and reads it as a user would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import dates, ids, text
from ledgerline.operators import edits
from ledgerline.operators.receipts import retry_schedule
from ledgerline.plans import adapter, oracle, reports, views
from ledgerline.plans.catalogue import ORACLE, S, _with, ledger, query
from ledgerline.sources import eventlog, polls, sinks, spoken
from ledgerline.sources import feed as feed_source
from ledgerline.sources.importer import import_folder
from ledgerline.sources.snapshots import Store
from ledgerline.storage import new_path, once
from ledgerline.streaming import ingest, stateful

_HEADERS = {
    "credit": ["Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit"], "checking": ["Account Number,Transaction Date,Transaction Amount,Transaction Type,Transaction Description,Balance"],
    "card": ["Transaction Date,Clearing Date,Description,Merchant,Category,Type,Amount (USD)"], "ofx": ["OFXHEADER:100", "<OFX><ACCTID>000004471"], "other": ["Date,What"], "blank": [""],
}
_KINDS = list(_HEADERS)
_SHARD = 20_000


def _plain(cents):
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def exports(spark: SparkSession, sf_dir: str) -> str:
    """A folder of statement exports of all line items: six kinds of files, as many of each as the orders need."""
    k = adapter.read(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    amount = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(_plain(cents))
    refund, day = F.col("l_returnflag") == "R", F.to_date("l_shipdate")
    us = lambda d: F.date_format(d, "MM/dd/yyyy")
    what = F.concat(F.lit('"PART, ""'), F.col("l_partkey").cast("string"), F.lit('"""'))
    none, tail = F.lit(""), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    csv = lambda *cells: F.concat_ws(",", *cells)
    rows = {
        "credit": csv(day.cast("string"), F.date_add(day, 1).cast("string"), tail, what, F.lit("x"), F.when(refund, none).otherwise(amount), F.when(refund, amount).otherwise(none)),
        "checking": csv(tail, us(day), F.concat(F.lit('"$'), amount, F.lit('"')), F.when(refund, "Credit").otherwise("Debit"), what, F.lit("0")),
        "card": csv(us(day), us(F.date_add(day, 1)), what, F.lit("Shop"), F.lit("x"), F.when(refund, "Payment").otherwise("Purchase"), amount),
        "ofx": F.concat(F.lit("<STMTTRN><DTPOSTED>"), F.date_format(day, "yyyyMMdd"), F.lit("120000<TRNAMT>"), F.when(refund, none).otherwise("-"), amount, F.lit("<FITID>"), F.col("l_orderkey").cast("string"), F.lit("<NAME>PART "), F.col("l_partkey").cast("string"), F.lit("</STMTTRN>")),
        "other": csv(day.cast("string"), what), "blank": csv(day.cast("string"), what),
    }
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("l_orderkey") % len(_KINDS)).cast("int") + 1)
    value = F.coalesce(*[F.when(kind == n, v) for n, v in rows.items()])
    shard = F.floor(F.col("l_orderkey") / _SHARD).cast("int")
    lines = k.select(kind.alias("kind"), shard.alias("shard"), F.lit(len(_KINDS)).alias("at"), value.alias("value"))
    heads = lines.select("kind", "shard").distinct().select("kind", "shard", F.explode(F.coalesce(*[F.when(F.col("kind") == n, F.array(*map(F.lit, h))) for n, h in _HEADERS.items()])).alias("value"))
    heads = heads.withColumn("at", F.when(F.col("value").startswith("<OFX>"), 1).otherwise(0))
    path = new_path(spark, "exports")
    lines.unionByName(heads).repartition("kind", "shard").sortWithinPartitions("kind", "shard", "at", "value").select("value", "kind", "shard").write.partitionBy("kind", "shard").text(path)
    return path


_LINES = f"k AS (SELECT *, {_KINDS!r}[1 + l_orderkey % {len(_KINDS)}] AS kind, (l_orderkey // {_SHARD})::INT AS shard, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag = 'R' AS refund, CAST(l_shipdate AS DATE) AS day, lpad(l_suppkey::VARCHAR, 6, '0') AS tail FROM lineitem)"


@query(_with(_LINES) + """SELECT kind, shard, CASE WHEN kind IN ('other', 'blank') THEN 'error' WHEN count(*) FILTER (WHERE l_linenumber = 7) > 0 THEN 'partial' ELSE 'ok' END AS outcome,
CASE kind WHEN 'credit' THEN 'capitalone-credit' WHEN 'checking' THEN 'capitalone-checking' WHEN 'card' THEN 'applecard' WHEN 'ofx' THEN 'ofx' END AS dialect, CASE WHEN kind IN ('other', 'blank') THEN 0 ELSE count(*) END AS rows,
CASE WHEN kind IN ('other', 'blank') THEN 0 ELSE count(*) FILTER (WHERE l_linenumber = 7) END AS bad, CASE WHEN kind IN ('other', 'blank', 'ofx') THEN 0 ELSE count(*) END AS synthesised,
CASE kind WHEN 'other' THEN 'no dialect claims these columns: Date, What' WHEN 'blank' THEN 'the file has no header row' END AS note FROM k GROUP BY kind, shard""")
def s9_import_outcomes(spark, sf_dir):
    """Each file of a mixed folder: what it is, what came of it, and why not."""
    files = import_folder(spark, exports(spark, sf_dir)).files
    part = lambda name: F.regexp_extract("file", f"{name}=([^/]+)/", 1)
    return files.select(part("kind").alias("kind"), part("shard").cast("int").alias("shard"), "outcome", "dialect", "rows", "bad", "synthesised", "note")


@query(_with(_LINES) + """SELECT CASE kind WHEN 'credit' THEN 'drop:capitalone-credit:' || tail[3:] WHEN 'checking' THEN 'drop:capitalone-checking:' || tail[3:] WHEN 'card' THEN 'drop:applecard:apple-card' ELSE 'drop:ofx:4471' END AS native_account,
strftime(CASE WHEN kind IN ('credit', 'card') THEN day + 1 ELSE day END, '%Y-%m-%d') AS posted_at, strftime(day, '%Y-%m-%d') AS transacted_at, CASE WHEN kind = 'ofx' THEN 'PART ' || l_partkey ELSE 'PART, "' || l_partkey || '"' END AS description,
CASE WHEN kind = 'card' THEN 'Shop' END AS payee, CASE WHEN kind = 'card' AND refund THEN 'payment' END AS flow_hint, CASE WHEN l_linenumber <> 7 THEN CASE WHEN refund THEN cents ELSE -cents END END AS amount_cents,
CASE WHEN l_linenumber = 7 THEN 'no digits in ''' || CASE WHEN kind = 'checking' THEN '$n/a' WHEN kind = 'ofx' AND NOT refund THEN '-n/a' ELSE 'n/a' END || '''' END AS reject_reason, count(*) AS n
FROM k WHERE kind NOT IN ('other', 'blank') GROUP BY ALL""")
def s1_statement_rows(spark, sf_dir):
    """What the rows of all dialects say, equal ones counted."""
    rows = import_folder(spark, exports(spark, sf_dir)).rows
    columns = ["native_account", "posted_at", "transacted_at", "description", "payee", "flow_hint", "amount_cents", "reject_reason"]
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR text IS NULL THEN NULL ELSE sha256('Date: ' || strftime(said_at, '%Y-%m-%d') || chr(10) || 'Time: ' || strftime(said_at, '%H:%M') || chr(10) || chr(10) || trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10)) END AS sha256 FROM (SELECT *, TIMESTAMP '2001-01-01' + to_seconds(conv_id * 977 + turn) AS said_at FROM conversations)")
def s18_text_receipts(spark, sf_dir):
    said = adapter.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.timestamp_seconds(978307200 + F.col("conv_id") * 977 + F.col("turn")).alias("said_at"))
    told, refused = spoken.text_receipts(said)
    return told.select("conv_id", "turn", "sha256").unionByName(refused.select("conv_id", "turn", F.lit(None).cast("string").alias("sha256")))


_STORED = _with(oracle.COLLAPSED) + "SELECT source, native_account, external_id, amount_cents, observed_at FROM dedup"
_STORED_COLUMNS = ["source", "native_account", "external_id", "amount_cents", "observed_at"]


@query(_STORED)
def x8_record_poll(spark, sf_dir):
    """Two polls recorded, the second of which sees all that the first has seen; and recorded again."""
    store = Store(spark, new_path(spark, "store"))
    records = once(adapter.records(spark, sf_dir).drop("uid", "content_sha256").withColumn("poll_uid", F.lit("p")), "poll")  # an answer is a file, and is read several times
    seen = adapter.polls(spark, sf_dir)
    accounts = adapter.account_observations(spark, sf_dir)
    for part, of in ((records.filter(F.crc32(F.col("external_id").cast("binary")) % 3 > 0), seen.limit(1)), (records, seen), (records, seen)):
        polls.record_poll(store, of, accounts, part)
    return store.table("feed_records").select(_STORED_COLUMNS)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'changed' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 > 0")
def k4_replace_projection(spark, sf_dir):
    """A table replaced as a whole, by rows that a reader takes from its last version."""
    store, c = Store(spark, new_path(spark, "store")), adapter.read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    store.replace(customers=c, names=c.select("c_name"))
    old = store.table("customers").filter("c_custkey % 3 > 0")
    store.replace(customers=old.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, "changed").otherwise(F.col("c_name"))))
    return store.table("customers")


def _delivered(rows: DataFrame, by: Column) -> tuple[str, int]:
    """rows as files in four folders, dealt by a hash, so without regard to time; each task writes what it has. Half of the files are a batch."""
    path = new_path(rows.sparkSession, "observations")
    rows.withColumn("delivery", F.pmod(by, F.lit(4)).cast("int")).write.option("compression", "zstd").partitionBy("delivery").parquet(path)
    return path, -(-len(rows.sparkSession.read.parquet(path).inputFiles()) // 2)


@query(_with(oracle.COLLAPSED) + "SELECT source, native_account, external_id, amount_cents FROM dedup")
def t1_overlapping_polls(spark, sf_dir):
    """The observations as a stream of files, appended where they are new. A bank's files have no digests."""
    store, told = Store(spark, new_path(spark, "store")), adapter.records(spark, sf_dir).drop("uid", "content_sha256", "poll_uid")
    path, half = _delivered(told, F.xxhash64("external_id", "amount_cents", "observed_at"))
    rows = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", half).parquet(path)
    ingest.append(rows, store, new_path(spark, "stream")).awaitTermination()
    return store.table("feed_records").select("source", "native_account", "external_id", "amount_cents")


_NEWEST = ["txn_key", "source", "native_account", "external_id", "amount_cents", "description", "first_seen_at", "last_seen_at", "revisions", "amount_changed"]


@query(ORACLE["a9_latest_observation"])
def t2_newest_stream(spark, sf_dir):
    """The observations as a stream of files in no order, each transaction's contents kept in state. Files have uids, which order, as bytes."""
    told, out = adapter.records(spark, sf_dir).drop("content_sha256", "poll_uid"), new_path(spark, "updates")
    told = told.withColumn("uid", F.unhex("uid"))
    path, half = _delivered(told, F.crc32("uid"))
    rows = stateful.with_state(spark).readStream.schema(told.schema).option("maxFilesPerTrigger", half).parquet(path).withColumn("content_sha256", ids.content_hash())
    stateful.into_folder(stateful.newest_transactions(rows, ["description"]), out, new_path(spark, "stream")).awaitTermination()
    return stateful.latest(spark.read.parquet(out), list(stateful.KEYS)).select(*_NEWEST)


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sha, l_orderkey::VARCHAR AS receipt FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM events) GROUP BY ALL")
def t3_replay_stream(spark, sf_dir):
    """Events as receipts and line items as what names them, in files in which either may come first."""
    path, out = new_path(spark, "events"), new_path(spark, "updates")
    at, lines = F.lit("2001-01-01").cast("timestamp"), adapter.read(spark, sf_dir, "lineitem")
    parents = adapter.read(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("sha"), F.lit("receipt").alias("kind"), at.alias("at"), F.col("event_id").cast("string").alias("receipt"), F.lit("{}").alias("body"))
    children = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sha"), F.lit("extraction").alias("kind"), at.alias("at"), F.col("l_orderkey").cast("string").alias("receipt"), F.lit("{}").alias("body"))
    both = parents.unionByName(children)
    both.repartition(4, F.crc32(F.col("sha").cast("binary"))).write.parquet(path)
    rows = stateful.with_state(spark).readStream.schema(both.schema).option("maxFilesPerTrigger", 2).parquet(path)
    stateful.into_folder(stateful.replayed(rows), out, new_path(spark, "stream")).awaitTermination()
    return stateful.latest(spark.read.parquet(out), ["sha"]).filter("status = 'resolved'").select("sha", "receipt")


@query("SELECT user_id, count(*) AS failures, max(ts) AS last_at, max(ts) + to_seconds(least(15 * power(2, least(count(*) - 1, 40)), 300)::BIGINT) AS due_at FROM events JOIN (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type <> 'error') AS ok FROM events GROUP BY 1) o USING (user_id) WHERE ok IS NULL OR (ts, event_id) > ok GROUP BY user_id")
def t4_retry_schedule(spark, sf_dir):
    tries = adapter.read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    return retry_schedule(tries, ["user_id"])


_EDITED = """ed AS (SELECT o_orderkey AS receipt_id, ['total', 'merchant', 'purchased_on', 'category', 'item.1.qty', 'deleted', 'colour'][1 + o_orderkey % 7] AS field, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query(_with(oracle.RECEIPTS, _EDITED) + """SELECT receipt_id, field, CASE field WHEN 'item.1.qty' THEN 'recorded' WHEN 'colour' THEN 'refused' WHEN 'deleted' THEN 'unchanged'
WHEN 'total' THEN CASE WHEN total_cents IS NOT DISTINCT FROM cents THEN 'unchanged' ELSE 'recorded' END WHEN 'merchant' THEN CASE WHEN merchant IS NULL THEN 'unchanged' ELSE 'recorded' END
WHEN 'purchased_on' THEN CASE WHEN purchased_on IS NOT DISTINCT FROM day THEN 'unchanged' ELSE 'recorded' END ELSE CASE WHEN category IS NOT DISTINCT FROM 'services' THEN 'unchanged' ELSE 'recorded' END END AS verdict FROM ed JOIN receipt_txn USING (receipt_id)""")
def x9_judged_edits(spark, sf_dir):
    """An edit of every receipt, by what would change."""
    o = adapter.read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    fields = ("total", "merchant", "purchased_on", "category", "item.1.qty", "deleted", "colour")
    values = (F.concat(F.lit("$"), _plain(cents)), F.lit(""), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("services"), F.lit("2"), F.lit(""), F.lit("red"))
    n = (F.col("o_orderkey") % len(fields)).cast("int") + 1
    changes = o.select(F.col("o_orderkey").alias("receipt_id"), F.element_at(F.array(*map(F.lit, fields)), n).alias("field"), F.element_at(F.array(*values), n).alias("value"))
    return edits.judged(changes, ledger(spark, sf_dir).receipt_transactions).select("receipt_id", "field", "verdict")


@query(_with(S) + "SELECT coalesce(strftime(dated_on, '%Y-%m'), '0000-00') AS month, count(*) AS n, sum(net_cost_cents)::BIGINT AS cents FROM feed WHERE NOT deleted GROUP BY 1")
def x10_publish(spark, sf_dir):
    """The ledger published twice; its month files as a reader finds them."""
    book, path = ledger(spark, sf_dir), new_path(spark, "published")
    for _ in range(2):
        book.publish(path, compression="gzip")
    lines = spark.read.text(f"{Store(spark, path).build()}/bank").select(F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0")).alias("month"), F.get_json_object("value", "$.net_cost_cents").cast("bigint").alias("cents"))
    return lines.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, '{\"day\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}' AS line FROM orders WHERE o_orderkey % 17 > 0 UNION ALL SELECT '0000-00', '{\"day\":null,\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}' FROM orders WHERE o_orderkey % 17 = 0")
def k6_month_files(spark, sf_dir):
    o = adapter.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 17 > 0, F.to_date("o_orderdate")).alias("day"), F.col("o_orderstatus").alias("s"))
    path = new_path(spark, "months")
    sinks.write_months(o, path, "day", "k")
    return spark.read.text(path).select(F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0")).alias("month"), F.col("value").alias("line"))


@query(_with(oracle.OBS) + "SELECT native_account, external_id, amount_cents, description, posted_on IS NULL OR pending AS pending, strftime(posted_on, '%Y-%m-%dT00:00:00Z') AS posted_at, strftime(transacted_on, '%Y-%m-%dT00:00:00Z') AS transacted_at, count(*) AS n FROM obs WHERE length(external_id) > 0 GROUP BY ALL")
def s11_feed_payload(spark, sf_dir):
    """The observations as feed payloads, one an order, and what is read from them."""
    r = adapter.records(spark, sf_dir)
    seconds = lambda c: F.unix_timestamp(F.to_timestamp(c))
    amount = F.when(F.col("amount_cents").isNotNull(), F.concat(F.when(F.col("amount_cents") < 0, "-").otherwise(""), _plain(F.abs("amount_cents"))))
    t = r.select(F.substring_index("external_id", "-", 1).alias("poll_uid"), "source", "native_account", F.struct(F.col("external_id").alias("id"), seconds("posted_at").alias("posted"), seconds("transacted_at").alias("transacted_at"), amount.alias("amount"), "description", "pending").alias("t"))
    accounts = t.groupBy("poll_uid", "source", "native_account").agg(F.collect_list("t").alias("transactions"))
    bodies = accounts.select("poll_uid", "source", F.lit("2001-01-01").cast("timestamp").alias("observed_at"), F.to_json(F.struct(F.array(F.struct(F.col("native_account").alias("id"), "transactions")).alias("accounts"))).alias("body"))
    read = feed_source.records(feed_source.parse(bodies))
    return read.groupBy("native_account", "external_id", "amount_cents", "description", "pending", "posted_at", "transacted_at").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, value::DECIMAL(18, 2)::VARCHAR AS value FROM events WHERE event_id % 50 > 0")
def x7_replay_log(spark, sf_dir):
    """Events through the log: JSON lines, some of them cut, scanned and read back as tables."""
    e = adapter.read(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_id", F.col("value").cast("decimal(18,2)").cast("string").alias("value")))
    logged = e.withColumn("body", body).select("event_type", eventlog.digest("event_type", "body").alias("sha"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "body", "event_id")
    line = F.to_json(F.struct("sha", F.col("event_type").alias("kind"), "at", "body"))
    path = new_path(spark, "log")
    cut = F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 30)).otherwise(line)
    both = logged.select(cut.alias("value"))
    both.unionAll(both).write.text(path)
    good, _ = eventlog.scan(spark, path)
    kinds = [r["kind"] for r in e.select(F.col("event_type").alias("kind")).distinct().orderBy("kind").collect()]  # the few kinds of a log
    tables = [eventlog.table_of(good, k, "event_id long, value string").select("event_id", F.lit(k).alias("event_type"), "value") for k in kinds]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query("SELECT page_id, 'https://***@' || regexp_replace(url, '^https?://', '') AS url FROM pages")
def f14_redaction(spark, sf_dir):
    return adapter.read(spark, sf_dir, "pages").select("page_id", text.redacted(F.concat(F.lit("https://user:secret@"), F.regexp_replace("url", "^https?://", ""))).alias("url"))


_RANK = "row_number() OVER (ORDER BY {})::INT AS place"


@query(_with(S) + f"SELECT month, category, cents, {_RANK.format('month DESC, cents DESC, category')} FROM ({ORACLE['q0_monthly_by_category'][len(_with(S)):]})")
def o1_mixed_sort(spark, sf_dir):
    """The monthly report's places: newest month first, and the largest category in it. Places are of a report, a row a category and month."""
    report = reports.monthly_by_category(views.costs(ledger(spark, sf_dir).unflagged))
    rows = report.agg(F.collect_list(F.struct("month", "category", "cents")).alias("r")).select(F.posexplode("r").alias("place", "r"))
    return rows.select("r.month", "r.category", "r.cents", (F.col("place") + 1).alias("place"))


@query(_with(oracle.RECEIPTS) + "SELECT receipt_id, month_cents FROM (SELECT receipt_id, coalesce(sum(total_cents) OVER (PARTITION BY strftime(purchased_on, '%Y-%m')), 0)::BIGINT AS month_cents FROM receipt_txn WHERE status = 'needs_review' AND category = 'services' AND strftime(purchased_on, '%Y-%m') = '2000-05')")
def p5_optional_filters(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return reports.receipt_page(book.receipt_transactions, book.receipts, month="2000-05", category="services", review=True).select("receipt_id", "month_cents")


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN TIMESTAMP '2001-01-01' + to_seconds(event_id * 61) END AS instant FROM events")
def s12_unix_instant(spark, sf_dir):
    seconds = F.when(F.col("event_id") % 10 == 0, 0).when(F.col("event_id") % 5 > 0, F.lit(978307200) + F.col("event_id") * 61)
    return adapter.read(spark, sf_dir, "events").select("event_id", dates.unix_instant(seconds).alias("instant"))


@query("SELECT user_id % 97 AS claimed, count(*) AS n FROM events WHERE user_id % 97 % 2 = 1 GROUP BY 1")
def s10_file_claim(spark, sf_dir):
    """Files of events by user, every second of which was claimed by its content; what is left, with its lines."""
    from ledgerline.sources.statements import unclaimed

    e, path = adapter.read(spark, sf_dir, "events"), new_path(spark, "claims")
    e.select(F.col("event_id").cast("string").alias("value"), (F.col("user_id") % 97).alias("u")).repartition("u").sortWithinPartitions("u", F.length("value"), "value").select("value", "u").write.partitionBy("u").text(path)
    every = unclaimed(spark, path, spark.createDataFrame([], "file_sha256 string"))
    u = F.regexp_extract("path", "u=([0-9]+)", 1).cast("bigint")
    left = unclaimed(spark, path, once(every.filter(u % 2 == 0), "claimed"))
    lines = spark.read.text(path).groupBy(F.col("u").cast("bigint").alias("claimed")).agg(F.count(F.lit(1)).alias("n"))
    return lines.join(left.select(u.alias("claimed")), "claimed", "left_semi")

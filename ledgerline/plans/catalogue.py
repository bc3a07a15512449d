"""Every query by name, with its SQL where SQL can say it. Names start with the operator's id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import dates, ids, money, payload, text
from ledgerline.operators import feed as feed_ops
from ledgerline.operators import lines, reconciliation, retention
from ledgerline.operators import observations as obs
from ledgerline.operators.receipts import project_receipts, work_queue
from ledgerline.plans import adapter, oracle, reports, schedule, views
from ledgerline.plans.ledger import Ledger
from ledgerline.schemas import OUTGO
from ledgerline.shipping import ship_package
from ledgerline.sources import eventlog, sinks
from ledgerline.storage import once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
AS_OF, ASD = adapter.AS_OF, oracle.AS_OF


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    a = adapter
    return Ledger(spark, a.rules(), a.records(spark, sf_dir, dealt=True), a.corrections(spark, sf_dir), a.account_observations(spark, sf_dir), a.polls(spark, sf_dir), a.receipts(spark, sf_dir), a.extractions(spark, sf_dir), a.receipt_corrections(spark, sf_dir))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship_package(spark), sf_dir)
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.costs(ledger(spark, sf_dir).unflagged)


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


S = oracle.FEED


@query(_with(S) + "SELECT month, coalesce(category, 'uncategorised') AS category, count(*) AS n, sum(net_cost_cents)::BIGINT AS cents FROM costs GROUP BY 1, 2")
def q0_monthly_by_category(spark, sf_dir):
    return reports.monthly_by_category(_costs(spark, sf_dir))


@query(_with(S) + f"SELECT merchant, n, cents, mean_cents, first_seen, last_seen FROM (SELECT merchant_key, merchant, count(*) AS n, sum(net_cost_cents)::BIGINT AS cents, trunc(avg(net_cost_cents))::BIGINT AS mean_cents, min(date) AS first_seen, max(date) AS last_seen FROM costs WHERE date >= {ASD} - 90 GROUP BY 1, 2 ORDER BY cents DESC, merchant_key, merchant LIMIT 30)")
def q1_top_merchants(spark, sf_dir):
    return reports.top_merchants(_costs(spark, sf_dir), AS_OF)


@query(_with(S, oracle.MONTHS, "per AS (SELECT month, coalesce(category, 'uncategorised') AS category, sum(net_cost_cents)::BIGINT AS cents FROM costs WHERE month IN (SELECT month FROM months) GROUP BY 1, 2)", "two AS (SELECT category, max(CASE WHEN month = (SELECT max(month) FROM months) THEN cents END) AS this_month, trunc(avg(CASE WHEN month <> (SELECT max(month) FROM months) THEN cents END))::BIGINT AS prior_mean FROM per GROUP BY 1)") + "SELECT category, this_month, prior_mean, this_month - prior_mean AS delta FROM two")
def q2_month_over_month(spark, sf_dir):
    return reports.month_over_month(_costs(spark, sf_dir), AS_OF)


@query(_with(S, oracle.MONTHS, "hits AS (SELECT merchant_key, merchant, month, sum(net_cost_cents)::BIGINT AS cents FROM costs WHERE month IN (SELECT month FROM months) AND merchant_key IS NOT NULL GROUP BY 1, 2, 3)") + "SELECT merchant, count(*) AS months_charged, min(cents) AS low_cents, max(cents) AS high_cents, trunc(avg(cents))::BIGINT AS typical_cents FROM hits GROUP BY merchant_key, merchant HAVING count(*) >= 3 AND max(cents) - min(cents) <= avg(cents) * 0.75")
def q3_recurring(spark, sf_dir):
    return reports.recurring(_costs(spark, sf_dir), AS_OF, spread=0.75)


@query(_with(S, "stats AS (SELECT merchant_key, avg(net_cost_cents) AS mean, count(*) AS times FROM costs WHERE merchant_key IS NOT NULL GROUP BY 1)") + f"SELECT date, merchant, category, net_cost_cents AS cents, trunc(mean)::BIGINT AS merchant_mean, CASE WHEN times = 1 THEN 'first time here' ELSE 'well above its usual' END AS why FROM costs JOIN stats USING (merchant_key) WHERE date >= {ASD} - 180 AND ((times > 1 AND net_cost_cents > mean * 3) OR (times = 1 AND net_cost_cents > 10000))")
def q4_unusual(spark, sf_dir):
    return reports.unusual(_costs(spark, sf_dir), AS_OF)


@query(_with(S) + "SELECT dated_on AS date, account_key AS account, merchant, description, flow, amount_cents, net_cost_cents, revisions, status, review_reason, CASE WHEN pending THEN 'not settled yet' ELSE 'restated after posting' END AS what FROM feed WHERE NOT deleted AND (pending OR amount_changed OR status = 'needs_review')")
def q5_pending_and_restated(spark, sf_dir):
    return reports.pending_and_restated(ledger(spark, sf_dir).unflagged)


@query(_with(S, oracle.ACCOUNTS, "cov AS (SELECT account_key AS account, min(dated_on) AS covers_from, max(dated_on) AS covers_to FROM feed WHERE dated_on IS NOT NULL GROUP BY 1)") + "SELECT account, name, kind, institution, balance_cents, last_seen_at AS balance_at, covers_from, covers_to, last_seen_at, CASE WHEN unmapped THEN 'NOT IN accounts.toml' ELSE '' END AS warning FROM acc LEFT JOIN cov USING (account)")
def q6_balances(spark, sf_dir):
    return reports.balances(ledger(spark, sf_dir).accounts)


Q7_DAYS, Q7_CENTS = 4, 100_000
_NEAR = f"r.merchant_key = b.merchant_key AND abs(date_diff('day', b.date, r.date)) <= {Q7_DAYS} AND abs(r.total_cents - b.net_cost_cents) <= {Q7_CENTS}"
_R = f"rec AS (SELECT 'receipt:' || receipt_id AS id, purchased_on AS date, array_to_string(list_transform(string_split(merchant, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS merchant, merchant_key, total_cents FROM receipt_txn)"


@query(_with(S, oracle.RECEIPTS, _R, f"pairs AS (SELECT 'candidate pair' AS kind, r.date AS receipt_date, b.date AS bank_date, r.merchant, r.total_cents, b.net_cost_cents, r.id AS receipt, b.id AS bank FROM rec r JOIN costs b ON {_NEAR})") + f"SELECT * FROM pairs UNION ALL SELECT 'receipt with no candidate', date, NULL, merchant, total_cents, NULL, id, NULL FROM rec r WHERE total_cents IS NOT NULL AND id NOT IN (SELECT receipt FROM pairs) UNION ALL SELECT 'charge over $75 with no receipt', NULL, date, merchant, NULL, net_cost_cents, NULL, id FROM costs b WHERE net_cost_cents > 7500 AND id NOT IN (SELECT bank FROM pairs)")
def q7_receipt_candidates(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return reports.receipt_candidates(book.receipt_rows, views.costs(book.unflagged), Q7_DAYS, Q7_CENTS)


@query(ORACLE["q3_recurring"].replace("* 0.75", "* 0.10::DOUBLE"))
def q3_recurring_tight(spark, sf_dir):
    """At the report's own tolerance."""
    return reports.recurring(_costs(spark, sf_dir), AS_OF)


@query(ORACLE["q7_receipt_candidates"].replace(f"<= {Q7_CENTS}", "<= 2"))
def q7_receipt_candidates_tight(spark, sf_dir):
    """At the report's own tolerance."""
    book = ledger(spark, sf_dir)
    return reports.receipt_candidates(book.receipt_rows, views.costs(book.unflagged))


@query(ORACLE["q0_monthly_by_category"])
def q8_monthly_view(spark, sf_dir):
    return views.monthly(ledger(spark, sf_dir).unflagged)


@query(_with(S, oracle.RECEIPTS, _R) + "SELECT 'bank' AS stream, count(*) AS n, sum(net_cost_cents)::BIGINT AS cents FROM feed WHERE NOT deleted UNION ALL SELECT 'receipt', count(*), 0 FROM rec")
def q9_everything(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return views.everything(book.unflagged, book.receipt_rows).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum("net_cost_cents").alias("cents"))


@query(_with(oracle.RECEIPTS, "sub AS (SELECT strftime(purchased_on, '%Y-%m') AS month, coalesce(sum(total_cents) FILTER (WHERE status IN ('ok', 'needs_review')), 0)::BIGINT AS month_cents FROM receipt_txn GROUP BY 1)") + "SELECT receipt_id, sha256(receipt_id::VARCHAR) AS sha256, merchant, purchased_on, category, status, total_cents, month, month_cents FROM receipt_txn t JOIN sub ON strftime(purchased_on, '%Y-%m') IS NOT DISTINCT FROM month")
def q10_receipt_page(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return reports.receipt_page(book.receipt_transactions, book.receipts)


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 29 <> 0")
def q11_months_present(spark, sf_dir):
    return reports.months_present(ledger(spark, sf_dir).receipt_transactions)


@query(_with(oracle.RECEIPTS) + f"SELECT count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS receipts, coalesce(sum(total_cents) FILTER (WHERE status IN ('ok', 'needs_review') AND strftime(purchased_on, '%Y-%m') = '{AS_OF[:7]}'), 0)::BIGINT AS month_cents FROM receipt_txn")
def q12_health(spark, sf_dir):
    return reports.health(ledger(spark, sf_dir).receipt_transactions, AS_OF)


_DUP = "dup AS (SELECT *, first(native_account) OVER (PARTITION BY account_key, dated_on, amount_cents, merchant_key ORDER BY txn_key) <> native_account AND dated_on IS NOT NULL AND amount_cents IS NOT NULL AS duplicate_suspect FROM feed)"


@query(_with(S, _DUP) + "SELECT count(*) AS transactions, count(*) FILTER (WHERE pending) AS pending, count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE duplicate_suspect) AS duplicate_suspects, count(*) FILTER (WHERE amount_changed) AS amount_changed FROM dup WHERE NOT deleted")
def q13_feed_counters(spark, sf_dir):
    flagged = ledger(spark, sf_dir).flagged("deleted", "pending", "status", "amount_changed", "amount_cents")
    return reports.feed_counters(views.bank(flagged))


@query(_with(oracle.POLLS) + "SELECT source, max(started_at) FILTER (WHERE outcome <> 'error') AS last_ok, arg_max(note, (started_at, uid)) FILTER (WHERE outcome = 'error') AS last_error, count(*) AS polls, bool_or(broken) AS needs_a_human, date_diff('day', CAST(max(started_at) FILTER (WHERE outcome <> 'error') AS DATE), DATE '2024-03-01')::INT AS stale_days FROM polls GROUP BY source")
def q14_feed_health(spark, sf_dir):
    return reports.feed_health(adapter.polls(spark, sf_dir), "2024-03-01")


@query(_with(oracle.ACCOUNTS) + f"SELECT account AS account_key, last_seen_at, date_diff('day', CAST(last_seen_at AS DATE), {ASD})::INT AS days FROM acc WHERE last_seen_at < {ASD} - 3")
def q15_stale_accounts(spark, sf_dir):
    return reports.stale_accounts(ledger(spark, sf_dir).accounts, AS_OF)


@query(_with(oracle.POLLS) + "SELECT count(*) AS polls FROM polls WHERE started_at > TIMESTAMP '2024-01-15'")
def q16_polls_since(spark, sf_dir):
    return reports.polls_since(adapter.polls(spark, sf_dir), "2024-01-15 00:00:00")


@query(_with(oracle.POLLS) + "SELECT uid, source, outcome, started_at, CASE WHEN uid IN (SELECT lpad(l_orderkey::VARCHAR, 12, '0') FROM lineitem) THEN (SELECT count(*) FROM lineitem WHERE lpad(l_orderkey::VARCHAR, 12, '0') = uid) ELSE 0 END AS n_new FROM (SELECT * FROM polls ORDER BY started_at DESC, uid DESC LIMIT 20)")
def q17_poll_history(spark, sf_dir):
    new = adapter.read(spark, sf_dir, "lineitem").select(F.format_string("%012d", "l_orderkey").alias("poll_uid"))
    return reports.poll_history(adapter.polls(spark, sf_dir), new, 20)


@query(_with(oracle.ACCOUNTS) + "SELECT account AS account_key, name AS display_name, balance_cents, unmapped FROM acc")
def q18_account_report(spark, sf_dir):
    return reports.account_report(ledger(spark, sf_dir).accounts).select("account_key", "display_name", "balance_cents", "unmapped")


@query("SELECT count(*) FILTER (WHERE event_id % 50 <> 0) AS readable, count(*) FILTER (WHERE event_id % 50 = 0) AS unreadable, count(*) FILTER (WHERE event_id % 50 <> 0 AND event_id % 7 = 0) AS misnamed FROM events")
def q19_integrity(spark, sf_dir):
    e = adapter.read(spark, sf_dir, "events").withColumns({"kind": F.col("event_type"), "body": F.col("props")})
    e = e.withColumn("sha", F.when(F.col("event_id") % 7 == 0, "x").otherwise(eventlog.digest()))
    return eventlog.integrity(e.filter("event_id % 50 <> 0"), e.filter("event_id % 50 = 0"))


@query(_with(oracle.RECEIPTS) + "SELECT receipt_id, sha256(receipt_id::VARCHAR) AS sha256, merchant FROM receipt_txn")
def j1_inner(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return book.receipts.join(book.receipt_transactions, "receipt_id").select("receipt_id", "sha256", "merchant")


@query(_with(S) + "SELECT txn_key, CASE WHEN unmapped THEN NULL ELSE 'Account ' || substr(native_account, 5) END AS account_name, kind FROM feed")
def j3_left_outer(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.select("txn_key", "account_name", "kind")


@query(_with(S, oracle.RECEIPTS, _R) + f"SELECT r.id AS receipt, b.id AS bank FROM rec r JOIN costs b ON {_NEAR}")
def j4_range(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return reports.candidate_pairs(book.receipt_rows, views.costs(book.unflagged), Q7_DAYS, Q7_CENTS).select(F.col("r.id").alias("receipt"), F.col("b.id").alias("bank"))


@query(_with(S, oracle.RECEIPTS, _R) + f"SELECT r.id FROM rec r WHERE total_cents IS NOT NULL AND NOT EXISTS (SELECT 1 FROM costs b WHERE {_NEAR})")
def j5_anti_range(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return reports.receipts_alone(book.receipt_rows, views.costs(book.unflagged), Q7_DAYS, Q7_CENTS).select("id")


@query("SELECT o_orderkey AS receipt_id FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 29 = 0")
def j6_work_queue(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return work_queue(book.receipts, book.extractions)


@query(_with(S, oracle.MONTHS) + "SELECT id FROM costs WHERE month IN (SELECT month FROM months)")
def j7_semi(spark, sf_dir):
    s = once(_costs(spark, sf_dir).select("id", "date"), "costs")
    return s.withColumn("month", dates.month_key(F.col("date"))).join(F.broadcast(reports.recent_months(s, AS_OF)), "month", "left_semi").select("id")


@query("SELECT lpad(l_orderkey::VARCHAR, 12, '0') AS sha256, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT event_id FROM events) GROUP BY 1")
def j12_orphans(spark, sf_dir):
    lines = adapter.read(spark, sf_dir, "lineitem").select(F.format_string("%012d", "l_orderkey").alias("sha256"))
    _, orphans = eventlog.resolved(lines, adapter.polls(spark, sf_dir).select(F.col("uid").alias("sha256")))
    return orphans.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))


@query(_with(oracle.COLLAPSED) + "SELECT txn_key, source, native_account, external_id, amount_cents, description, first_seen_at, last_seen_at, revisions, amount_changed FROM keyed")
def a9_latest_observation(spark, sf_dir):
    return obs.collapsed(obs.deduplicated(adapter.records(spark, sf_dir, dealt=True))).select("txn_key", "source", "native_account", "external_id", "amount_cents", "description", "first_seen_at", "last_seen_at", "revisions", "amount_changed")


@query(_with(S) + "SELECT txn_key, deleted, has_category, has_category AND new_category IS NULL AS cleared FROM edits WHERE deleted OR has_category OR has_merchant")
def a12_last_edits(spark, sf_dir):
    e = obs.last_edits(adapter.corrections(spark, sf_dir), "txn_key", ("merchant", "category", "deleted"), ["created_at", "uid"])
    return e.select("txn_key", F.col("edit_deleted").isNotNull().alias("deleted"), F.col("edit_category").isNotNull().alias("has_category"), (F.col("edit_category").isNotNull() & F.col("edit_category.value").isNull()).alias("cleared"))


@query(_with(oracle.COLLAPSED) + "SELECT count(*) AS n FROM dedup")
def a18_exact_dedup(spark, sf_dir):
    return obs.deduplicated(adapter.records(spark, sf_dir, dealt=True)).agg(F.count(F.lit(1)).alias("n"))


@query(_with(oracle.OBS) + "SELECT native_account, count(DISTINCT external_id) AS ids FROM obs GROUP BY 1")
def a19_seen_ids(spark, sf_dir):
    return obs.listed_ids(adapter.records(spark, sf_dir).withColumn("poll_uid", F.col("native_account"))).select("native_account", "ids")


@query(_with(oracle.POLLS) + "SELECT source, count(*) FILTER (WHERE CAST(started_at AS DATE) = DATE '2024-01-10') AS calls FROM polls GROUP BY 1")
def a22_daily_calls(spark, sf_dir):
    return schedule.calls_on(adapter.polls(spark, sf_dir), "2024-01-10")


@query(_with(S, _DUP) + "SELECT txn_key, account_key, source, posted_on, transacted_on, dated_on, pending, amount_cents, outflow_cents, inflow_cents, net_cost_cents, counts AS counts_as_cost, merchant, merchant_key, category, flow, status, review_reason, revisions, amount_changed, deleted, duplicate_suspect FROM dup")
def x3_project_feed(spark, sf_dir):
    return ledger(spark, sf_dir).feed_transactions.select("txn_key", "account_key", "source", "posted_on", "transacted_on", "dated_on", "pending", "amount_cents", "outflow_cents", "inflow_cents", "net_cost_cents", "counts_as_cost", "merchant", "merchant_key", "category", "flow", "status", "review_reason", "revisions", "amount_changed", "deleted", "duplicate_suspect")


@query(_with(oracle.RECEIPTS) + "SELECT receipt_id, merchant, merchant_key, purchased_on, total_cents, category, status FROM receipt_txn")
def x1_project_receipts(spark, sf_dir):
    return ledger(spark, sf_dir).receipt_transactions.select("receipt_id", "merchant", "merchant_key", "purchased_on", "total_cents", "category", "status")


@query(_with(oracle.RECEIPTS) + "SELECT receipt_id, row_number() OVER (PARTITION BY receipt_id ORDER BY n)::INT AS line_no, description, qty, total_cents FROM kept")
def f28_line_items(spark, sf_dir):
    return ledger(spark, sf_dir).items.select("receipt_id", "line_no", "description", "qty", "total_cents")


@query(_with(S, _DUP) + "SELECT txn_key, duplicate_suspect FROM dup")
def w4_duplicate_flag(spark, sf_dir):
    return ledger(spark, sf_dir).flagged("txn_key")


@query(_with(oracle.POLLS, "w AS (SELECT source, window_from AS s, max(window_to) AS e FROM polls WHERE outcome <> 'error' AND window_from IS NOT NULL GROUP BY 1, 2)", "r AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)") + "SELECT source, reach AS gap_from, s AS gap_to FROM r WHERE s > reach")
def w5_gaps(spark, sf_dir):
    return schedule.gaps(adapter.polls(spark, sf_dir))


@query(_with(oracle.POLLS) + "SELECT source, min(window_from) AS earliest, max(window_to) AS watermark FROM polls WHERE outcome <> 'error' AND window_from IS NOT NULL GROUP BY 1")
def w6_watermark(spark, sf_dir):
    return schedule.watermark(adapter.polls(spark, sf_dir))




@query("SELECT event_id, CASE event_id % 9 WHEN 0 THEN 123450 WHEN 1 THEN -1235 WHEN 2 THEN -750 WHEN 3 THEN 123400 WHEN 4 THEN 123457 WHEN 5 THEN -75 WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS cents, CASE event_id % 9 WHEN 6 THEN 'no digits in ''n/a''' WHEN 7 THEN 'not an amount: ''12.''' END AS reject_reason FROM events")
def f1_to_cents(spark, sf_dir):
    forms = ("$1,234.50", "(12.345)", "7.50-", "1,234", "1,234,567", "-0.745", "n/a", "12.")
    raw = F.element_at(F.array(*[F.lit(x) for x in forms], F.format_string("%.2f", "value")), (F.col("event_id") % 9).cast("int") + 1)
    return adapter.read(spark, sf_dir, "events").select("event_id", money.to_cents(raw).alias("m")).select("event_id", "m.*")


@query("SELECT o_orderkey, (CASE WHEN c < 0 THEN '-' ELSE '' END) || '$' || format('{:,}', abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS shown, (CASE WHEN c < 0 THEN '-' ELSE '' END) || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS plain FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) AS c FROM orders)")
def f4_format_cents(spark, sf_dir):
    c = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", money.format_cents(c).alias("shown"), money.amount_string(c).alias("plain"))


@query(_with(oracle.COLLAPSED, oracle.NAMED) + "SELECT txn_key, auto_name AS merchant FROM named")
def f10_merchant(spark, sf_dir):
    r = obs.collapsed(obs.deduplicated(adapter.records(spark, sf_dir, dealt=True)))
    rules = adapter.rules()
    return r.select("txn_key", text.merchant_name(F.col("description"), rules.merchants.match_spaced(F.col("description"))).alias("merchant"))


#: White space beyond ASCII, which the other engine's \s leaves out.
_SPACES = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_KEY = f"nullif(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_{_SPACES}]', '', 'g'), '[{_SPACES}]+', ' ', 'g')), '')"


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def f11_merchant_key(spark, sf_dir):
    """Over all documents, in all their languages."""
    return adapter.read(spark, sf_dir, "documents").select("doc_id", text.merchant_key(F.col("text")).alias("key"))


@query(f"SELECT key, count(*) AS n FROM (SELECT {_KEY} AS key FROM documents) GROUP BY 1")
def f11_merchant_key_all(spark, sf_dir):
    """How many documents share each key."""
    return f11_merchant_key(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def f13_slug(spark, sf_dir):
    return adapter.read(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def f17_parse_date(spark, sf_dir):
    forms = ("yyyy-MM-dd", "M/d/yyyy", "MM/dd/yy", "yyyy/MM/dd", "MM-dd-yyyy", "yyyyMMdd'120000[-5:EST]'")
    written = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % len(forms)).cast("int") + 1)
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(written).alias("day"))


@query("SELECT event_id, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS day FROM events")
def f18_local_date(spark, sf_dir):
    return adapter.read(spark, sf_dir, "events").select("event_id", dates.local_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "America/New_York").alias("day"))


@query("SELECT l_orderkey, l_linenumber, substr(sha256('drop' || chr(31) || l_partkey || chr(31) || l_suppkey), 1, 24) AS txn_key FROM lineitem")
def f23_txn_key(spark, sf_dir):
    return adapter.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.txn_key(F.lit("drop"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("txn_key"))


@query(_with(oracle.OBS) + "SELECT id, count(*) AS n FROM (SELECT substr(sha256(native_account || chr(31) || strftime(posted_on, '%Y-%m-%d') || chr(31) || coalesce(amount_cents::VARCHAR, 'None') || chr(31) || description || chr(31) || (row_number() OVER (PARTITION BY native_account, posted_on, amount_cents, description ORDER BY uid) - 1)), 1, 24) AS id FROM obs) GROUP BY 1")
def f26_synthesised_id(spark, sf_dir):
    r = adapter.records(spark, sf_dir)
    return r.select(ids.synthesised_id(F.col("uid")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(_with(oracle.POLLS) + "SELECT source, count(*) FILTER (WHERE broken) AS broken FROM polls GROUP BY 1")
def f30_error_codes(spark, sf_dir):
    return adapter.polls(spark, sf_dir).groupBy("source").agg(F.count_if(payload.needs_a_human(F.col("errors"))).alias("broken"))


@query("SELECT p_partkey, " + oracle.first_match(oracle.R.categories, "lower(p_name)") + " AS category FROM part")
def r1_category(spark, sf_dir):
    return adapter.read(spark, sf_dir, "part").select("p_partkey", adapter.rules().categories.match(F.col("p_name")).alias("category"))


@query(_with(S) + "SELECT flow, status, count(*) AS n, sum(net_cost_cents)::BIGINT AS net, sum(outflow_cents)::BIGINT AS outflow, sum(inflow_cents)::BIGINT AS inflow FROM feed GROUP BY 1, 2")
def r9_decomposition(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.groupBy("flow", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("net_cost_cents").alias("net"), F.sum("outflow_cents").alias("outflow"), F.sum("inflow_cents").alias("inflow"))


@query("SELECT c_custkey, c_name, round(c_acctbal * 100)::BIGINT + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS cents FROM customer")
def k5_upsert(spark, sf_dir):
    c = adapter.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"))
    return sinks.upserted(c, c.filter("c_custkey % 5 = 0").withColumn("cents", F.col("cents") + 1), ["c_custkey"], ["cents"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def k2_insert_new(spark, sf_dir):
    o = adapter.read(spark, sf_dir, "orders").select("o_orderkey")
    return sinks.new_rows(o.unionAll(o), o.filter("o_orderkey % 3 = 0"), ["o_orderkey"], ["o_orderkey"])


@query(_with(S) + "SELECT min(dated_on) AS bank_from, max(dated_on) AS bank_to, count(*) AS bank_rows FROM feed WHERE NOT deleted")
def k9_manifest(spark, sf_dir):
    book = ledger(spark, sf_dir)
    return sinks.manifest(book.unflagged, book.receipt_rows, book.polls).select("bank_from", "bank_to", "bank_rows")


@query(_with(S) + "SELECT txn_key AS id FROM feed WHERE NOT deleted AND dated_on >= DATE '2001-07-01' AND dated_on < DATE '2001-08-01'")
def p6_month_filter(spark, sf_dir):
    return reports.month_filter(ledger(spark, sf_dir).unflagged, "2001-07").select("id")


@query(_with(S) + "SELECT account_key AS account, sum(net_cost_cents)::BIGINT AS cents FROM costs GROUP BY 1")
def s16_sql(spark, sf_dir):
    return ledger(spark, sf_dir).sql("SELECT account, sum(net_cost_cents) AS cents FROM costs GROUP BY account")


@query(_with(S, "stats AS (SELECT merchant_key, count(*) AS times FROM costs GROUP BY 1)") + "SELECT id, times FROM costs JOIN stats USING (merchant_key)")
def j2_join_on_aggregate(spark, sf_dir):
    s = once(_costs(spark, sf_dir).select("id", "merchant_key"), "costs")
    return s.join(s.groupBy("merchant_key").agg(F.count(F.lit(1)).alias("times")), "merchant_key").select("id", "times")


@query(_with(S, oracle.MONTHS) + "SELECT id, coalesce(month = (SELECT max(month) FROM months), false) AS latest FROM costs")
def j8_scalar_subquery(spark, sf_dir):
    s = once(_costs(spark, sf_dir).select("id", "date"), "costs")
    latest = reports.recent_months(s, AS_OF).agg(F.max("month").alias("m"))
    return s.crossJoin(F.broadcast(latest)).select("id", F.coalesce(dates.month_key(F.col("date")) == F.col("m"), F.lit(False)).alias("latest"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
def j9_correlated_count(spark, sf_dir):
    n = adapter.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(_with(S) + "SELECT DISTINCT native_account, account_key, unmapped FROM feed")
def j11_account_membership(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.select("native_account", "account_key", "unmapped").distinct()


@query(_with(S) + "SELECT account_key, count(*) AS n, sum(amount_cents)::BIGINT AS total, min(amount_cents) AS low, max(amount_cents) AS high, trunc(avg(amount_cents))::BIGINT AS mean FROM feed GROUP BY 1")
def a2_truncated_mean(spark, sf_dir):
    c = F.col("amount_cents")
    return ledger(spark, sf_dir).feed_rows.groupBy("account_key").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"), F.min(c).alias("low"), F.max(c).alias("high"), reports.truncated_mean(c).alias("mean"))


@query(_with(S) + "SELECT account_key, min(dated_on) AS covers_from, max(dated_on) AS covers_to FROM feed WHERE dated_on IS NOT NULL GROUP BY 1")
def a16_coverage(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.filter("dated_on is not null").groupBy("account_key").agg(F.min("dated_on").alias("covers_from"), F.max("dated_on").alias("covers_to"))


@query(_with(oracle.ACCOUNTS) + "SELECT source, native_id, balance_cents FROM acc_new")
def a17_newest_account_state(spark, sf_dir):
    return obs.latest_of_each(adapter.account_observations(spark, sf_dir), ["source", "native_id"], ["observed_at", "uid"]).select("source", "native_id", "balance_cents")


@query(_with(oracle.RECEIPTS) + "SELECT receipt_id, item_cents FROM sums")
def a20_item_sums(spark, sf_dir):
    return ledger(spark, sf_dir).items.groupBy("receipt_id").agg(F.sum("total_cents").alias("item_cents"))


@query(_with(S) + f"SELECT txn_key, {oracle.first_match(oracle.R.flows, 'low')} AS rule FROM feed")
def r3_flow_rule(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.select("txn_key", adapter.rules().flows.match_spaced(F.col("description")).alias("rule"))


@query(_with(S) + f"SELECT txn_key, CASE WHEN amount_cents IS NULL THEN 'unknown' WHEN amount_cents < 0 THEN '{OUTGO}' WHEN kind = 'credit' THEN 'refund' WHEN kind IN ('checking', 'savings') THEN 'income' ELSE 'unknown' END AS flow FROM feed")
def r5_structural_flow(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.select("txn_key", feed_ops.structural_flow(F.col("amount_cents"), F.col("kind")).alias("flow"))


@query(_with(S) + "SELECT status, review_reason, count(*) AS n FROM feed GROUP BY 1, 2")
def r10_status_ladder(spark, sf_dir):
    return ledger(spark, sf_dir).feed_rows.groupBy("status", "review_reason").agg(F.count(F.lit(1)).alias("n"))


@query(_with(S, oracle.MONTHS) + "SELECT month FROM months")
def w8_top_months(spark, sf_dir):
    return reports.recent_months(_costs(spark, sf_dir), AS_OF)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o4_top_k(spark, sf_dir):
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS tail FROM customer")
def f12_last_four(spark, sf_dir):
    return adapter.read(spark, sf_dir, "customer").select("c_custkey", text.last_four(F.col("c_name"), "acct").alias("tail"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %Y') AS label, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def f22_month_label(spark, sf_dir):
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", dates.month_label(F.to_date("o_orderdate")).alias("label"), dates.month_key(F.to_date("o_orderdate")).alias("month"))


@query("SELECT event_id, sha256(event_type || chr(31) || props) AS sha FROM events")
def f25_record_digest(spark, sf_dir):
    return adapter.read(spark, sf_dir, "events").select("event_id", eventlog.digest("event_type", "props").alias("sha"))


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation")
def f29_sorted_json(spark, sf_dir):
    return adapter.read(spark, sf_dir, "nation").select("n_nationkey", payload.sorted_json("n_nationkey", "n_name", "n_regionkey").alias("line"))


@query("SELECT o_orderkey, greatest(-c, 0) AS outflow, greatest(c, 0) AS inflow FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) * (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) END AS c FROM orders) WHERE c IS NOT NULL UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0")
def f31_clamp(spark, sf_dir):
    c = F.when(F.col("o_orderkey") % 5 != 0, F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1))
    return adapter.read(spark, sf_dir, "orders").select("o_orderkey", money.outflow(c).alias("outflow"), money.inflow(c).alias("inflow"))


@query("SELECT DISTINCT l_orderkey || '-' || l_linenumber AS external_id FROM lineitem WHERE l_orderkey % 10 <> 0")
def d1_vanished(spark, sf_dir):
    """Transactions of listed accounts that the newest poll no longer has; here, it lists every tenth order."""
    lines = adapter.records(spark, sf_dir).select(F.lit("s").alias("source"), F.lit("a").alias("native_account"), "external_id").distinct()
    return obs.vanished(lines, lines.filter(F.substring_index("external_id", "-", 1).cast("bigint") % 10 == 0)).select("external_id")


@query("""WITH f AS (
  SELECT doc_id, w.i - 1 AS seq, ((w.i - 1) * 37) % 101 AS x, 10 * ((w.i - 1) // 8) + ((w.i - 1) * 7) % 5 AS y, 4 + length(w.t) % 9 AS h, w.t AS text
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS t) w
), b AS (SELECT *, CASE WHEN abs(y - lag(y) OVER o) > 0.6::DOUBLE * greatest(h, lag(h) OVER o) THEN 1 ELSE 0 END AS brk FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY y, seq)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY y, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS line_no FROM b)
SELECT doc_id, line_no, count(*) AS fragments, string_agg(text, '  ' ORDER BY x, y, seq) AS line FROM n GROUP BY 1, 2""")
def w9_line_clustering(spark, sf_dir):
    """The words of every document, placed eight to a row of ten units, shuffled within it and uneven in height."""
    words = adapter.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("i", "text"))
    i = F.col("i").cast("bigint")
    placed = words.select("doc_id", i.alias("seq"), (i * 37 % 101).alias("x"), (10 * F.floor(i / 8) + i * 7 % 5).alias("y"), (4 + F.length("text") % 9).alias("h"), "text")
    return lines.cluster_lines(placed, "doc_id")


_EVICT_BUDGET = 1_000_000


@query(f"WITH f AS (SELECT doc_id AS path, make_timestamp(978307200000000 + (doc_id % 997) * 1000000) AS \"at\", strlen(text) AS bytes FROM documents), s AS (SELECT *, sum(coalesce(bytes, 0)) OVER () AS total, sum(coalesce(bytes, 0)) OVER (ORDER BY \"at\", bytes NULLS FIRST, path ROWS UNBOUNDED PRECEDING) - coalesce(bytes, 0) AS freed FROM f) SELECT path, \"at\", bytes FROM s WHERE total - freed > {_EVICT_BUDGET}")
def w10_eviction(spark, sf_dir):
    """Documents as files of a store with room for a million bytes."""
    files = adapter.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.timestamp_seconds(978307200 + F.col("doc_id") % 997).alias("at"), F.octet_length("text").cast("bigint").alias("bytes"))
    return retention.evicted(files, _EVICT_BUDGET)


@query(_with(S, oracle.ACCOUNTS) + """, moves AS (SELECT native_account AS account, dated_on AS day, 0 AS kind, NULL::TIMESTAMP AS "at", NULL AS uid, sum(amount_cents)::BIGINT AS amount, NULL::BIGINT AS balance_cents FROM feed WHERE dated_on IS NOT NULL AND amount_cents IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT native_id, CAST(observed_at AS DATE), 1, observed_at, uid, NULL, balance_cents FROM acc_obs),
run AS (SELECT *, coalesce(sum(amount) OVER (PARTITION BY account ORDER BY day, kind, "at" NULLS FIRST, uid ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS moved_cents FROM moves),
obs2 AS (SELECT *, lag(balance_cents) OVER w AS previous_balance_cents, moved_cents - lag(moved_cents) OVER w AS explained_cents FROM run WHERE kind = 1 WINDOW w AS (PARTITION BY account ORDER BY day, "at", uid))
SELECT account, "at", uid, balance_cents, moved_cents, previous_balance_cents, explained_cents, balance_cents - previous_balance_cents - explained_cents AS unexplained_cents FROM obs2""")
def d2_balance_reconciliation(spark, sf_dir):
    book = ledger(spark, sf_dir)
    seen = book.feed_accounts.select(F.col("native_id").alias("account"), F.col("balance_at").alias("at"), "uid", "balance_cents")
    return reconciliation.reconciled(seen, book.feed_rows.select(F.col("native_account").alias("account"), F.col("dated_on").alias("day"), "amount_cents"))

"""The canned queries. `as_of` is the day they are asked on; nothing reads the clock.

What a query reads twice, it evaluates once: the few columns it needs are written to the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_key
from ledgerline.functions.payload import needs_a_human
from ledgerline.storage import once

UNCATEGORISED = "uncategorised"


def _as_of(day: str) -> Column:
    return F.lit(day).cast("date")


def truncated_mean(c: Column | str) -> Column:
    return F.avg(c).cast("bigint")


def _category() -> Column:
    return F.coalesce("category", F.lit(UNCATEGORISED))


def recent_months(costs: DataFrame, as_of: str, n: int = 4) -> DataFrame:
    """(month) of the n latest months that are over and have costs: n rows at most."""
    return costs.select(month_key(F.col("date")).alias("month")).filter(F.col("month") < month_key(_as_of(as_of))).distinct().orderBy(F.desc("month")).limit(n)


def monthly_by_category(costs: DataFrame) -> DataFrame:
    return costs.groupBy(month_key(F.col("date")).alias("month"), _category().alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("net_cost_cents").alias("cents")).orderBy(F.desc("month"), F.desc("cents"))


def top_merchants(costs: DataFrame, as_of: str, days: int = 90, n: int = 30) -> DataFrame:
    recent = costs.filter(F.col("date") >= F.date_sub(_as_of(as_of), days))
    sums = recent.groupBy("merchant_key", "merchant").agg(F.count(F.lit(1)).alias("n"), F.sum("net_cost_cents").alias("cents"), truncated_mean("net_cost_cents").alias("mean_cents"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))
    return sums.orderBy(F.desc("cents"), "merchant_key", "merchant").limit(n).drop("merchant_key")


def month_over_month(costs: DataFrame, as_of: str) -> DataFrame:
    costs = once(costs.select("date", "category", "net_cost_cents"), "costs")
    months = recent_months(costs, as_of)
    latest = months.agg(F.max("month").alias("latest"))
    per = costs.withColumn("month", month_key(F.col("date"))).join(F.broadcast(months), "month", "left_semi").groupBy("month", _category().alias("category")).agg(F.sum("net_cost_cents").alias("cents"))
    now = F.when(F.col("month") == F.col("latest"), F.col("cents"))
    before = F.when(F.col("month") != F.col("latest"), F.col("cents"))
    out = per.crossJoin(F.broadcast(latest)).groupBy("category").agg(F.max(now).alias("this_month"), truncated_mean(before).alias("prior_mean"))
    return out.withColumn("delta", F.col("this_month") - F.col("prior_mean")).orderBy(F.desc("delta"))


def recurring(costs: DataFrame, as_of: str, spread: float = 0.10, least: int = 3) -> DataFrame:
    costs = once(costs.select("date", "merchant_key", "merchant", "net_cost_cents"), "costs")
    hits = costs.filter("merchant_key is not null").withColumn("month", month_key(F.col("date"))).join(F.broadcast(recent_months(costs, as_of)), "month", "left_semi").groupBy("merchant_key", "merchant", "month").agg(F.sum("net_cost_cents").alias("cents"))
    out = hits.groupBy("merchant_key", "merchant").agg(F.count(F.lit(1)).alias("months_charged"), F.min("cents").alias("low_cents"), F.max("cents").alias("high_cents"), F.avg("cents").alias("mean"))
    kept = out.filter((F.col("months_charged") >= least) & (F.col("high_cents") - F.col("low_cents") <= F.col("mean") * spread))
    return kept.select("merchant", "months_charged", "low_cents", "high_cents", F.col("mean").cast("bigint").alias("typical_cents")).orderBy(F.desc("typical_cents"))


def unusual(costs: DataFrame, as_of: str, days: int = 180, times: int = 3, first_over: int = 10_000) -> DataFrame:
    """Means are over all history, one small row a merchant; the charges are recent ones only."""
    costs = once(costs.select("date", "merchant_key", "merchant", "category", "net_cost_cents"), "costs")
    stats = costs.filter("merchant_key is not null").groupBy("merchant_key").agg(F.avg("net_cost_cents").alias("mean"), F.count(F.lit(1)).alias("times"))
    s = costs.filter(F.col("date") >= F.date_sub(_as_of(as_of), days)).join(stats, "merchant_key")
    odd = ((F.col("times") > 1) & (F.col("net_cost_cents") > F.col("mean") * times)) | ((F.col("times") == 1) & (F.col("net_cost_cents") > first_over))
    return s.filter(odd).select("date", "merchant", "category", F.col("net_cost_cents").alias("cents"), F.col("mean").cast("bigint").alias("merchant_mean"), F.when(F.col("times") == 1, "first time here").otherwise("well above its usual").alias("why")).orderBy(F.desc("date"))


def pending_and_restated(bank: DataFrame) -> DataFrame:
    odd = bank.filter(F.col("pending") | F.col("amount_changed") | (F.col("status") == "needs_review"))
    return odd.select("date", "account", "merchant", "description", "flow", "amount_cents", "net_cost_cents", "revisions", "status", "review_reason", F.when(F.col("pending"), "not settled yet").otherwise("restated after posting").alias("what")).orderBy(F.desc("date"))


def balances(accounts: DataFrame) -> DataFrame:
    out = accounts.select(F.col("account_key").alias("account"), F.col("display_name").alias("name"), "kind", "institution", "balance_cents", "balance_at", "covers_from", "covers_to", "last_seen_at", F.when(F.col("unmapped"), "NOT IN accounts.toml").otherwise("").alias("warning"), "unmapped")
    return out.orderBy(F.desc("unmapped"), "account").drop("unmapped")


def _near(days: int, cents: int) -> Column:
    return (F.col("r.merchant_key") == F.col("b.merchant_key")) & (F.abs(F.datediff("r.date", "b.date")) <= days) & (F.abs(F.col("r.total_cents") - F.col("b.net_cost_cents")) <= cents)


def _in_bucket(rows: DataFrame, days: int) -> DataFrame:
    """Adds __b, the row's bucket of days. Rows without a date match nothing and are spread by their ids."""
    return rows.withColumn("__b", F.coalesce(_bucket(F.col("date"), days), F.xxhash64("id")))


def _in_near_buckets(rows: DataFrame, days: int) -> DataFrame:
    """Each row once in every bucket of days that its tolerance reaches: two at most."""
    usable = rows.filter("merchant_key is not null and date is not null")
    return usable.withColumn("__b", F.explode(F.array_distinct(F.array(_bucket(F.date_sub("date", days), days), _bucket(F.date_add("date", days), days)))))


def _bucket(day: Column, days: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (2 * days + 1))


def candidate_pairs(receipts: DataFrame, costs: DataFrame, days: int = 4, cents: int = 2, how: str = "inner") -> DataFrame:
    """Receipts (alias r) and charges (alias b) of one merchant, near in day and amount.

    Days are cut into buckets as wide as the tolerance, and each charge is offered to those it reaches, so
    one merchant's rows spread over as many tasks as it has buckets. how="left" keeps receipts without a charge.
    """
    r, b = _in_bucket(receipts, days), _in_near_buckets(costs, days)
    return r.alias("r").join(b.alias("b"), (F.col("r.__b") == F.col("b.__b")) & _near(days, cents), how)


def receipts_alone(receipts: DataFrame, costs: DataFrame, days: int = 4, cents: int = 2) -> DataFrame:
    """Receipts with a total and without a charge near them: an anti join of what is compared, nothing else is read, written or sorted."""
    priced = once(receipts.filter("total_cents is not null").select("id", "date", "merchant_key", "total_cents"), "receipts")
    charged = once(costs.select("date", "merchant_key", "net_cost_cents"), "costs")  # else the join's filters would make the keys anew
    return candidate_pairs(priced, charged, days, cents, "left_anti").select("id")


def receipt_candidates(receipts: DataFrame, costs: DataFrame, days: int = 4, cents: int = 2, over: int = 7500) -> DataFrame:
    """Candidate pairs, receipts without one, and large charges without one: one join from each side."""
    receipts = once(receipts.filter("total_cents is not null").select("id", "date", "merchant", "merchant_key", "total_cents"), "receipts")
    costs = once(costs.select("id", "date", "merchant", "merchant_key", "net_cost_cents"), "costs")
    kind = F.when(F.col("b.id").isNull(), "receipt with no candidate").otherwise("candidate pair")
    offered = candidate_pairs(receipts, costs, days, cents, "left").select(kind.alias("kind"), F.col("r.date").alias("receipt_date"), F.col("b.date").alias("bank_date"), F.col("r.merchant").alias("merchant"), F.col("r.total_cents").alias("total_cents"), F.col("b.net_cost_cents").alias("net_cost_cents"), F.col("r.id").alias("receipt"), F.col("b.id").alias("bank"))
    large, near = _in_bucket(costs.filter(F.col("net_cost_cents") > over), days), _in_near_buckets(receipts, days)
    alone = large.alias("b").join(near.alias("r"), (F.col("r.__b") == F.col("b.__b")) & _near(days, cents), "left_anti").select(F.lit("charge over $75 with no receipt").alias("kind"), F.col("date").alias("bank_date"), "merchant", "net_cost_cents", F.col("id").alias("bank"))
    return offered.unionByName(alone, allowMissingColumns=True).orderBy("kind", "receipt_date", "bank_date")


def receipt_page(transactions: DataFrame, receipts: DataFrame, month: str | None = None, category: str | None = None, review: bool = False) -> DataFrame:
    """Live receipts, newest first, with each month's subtotal of trusted ones; filters combine."""
    t = transactions.filter(~F.col("deleted"))
    if month:
        t = t.filter(month_key(F.col("purchased_on")) == month)
    if category:
        t = t.filter(F.col("category") == category)
    if review:
        t = t.filter("status = 'needs_review'")
    t = t.withColumn("month", month_key(F.col("purchased_on")))
    subtotal = t.groupBy("month").agg(F.coalesce(F.sum(F.when(F.col("status").isin("ok", "needs_review"), F.col("total_cents"))), F.lit(0)).alias("month_cents"))
    page = t.join(receipts.select("receipt_id", "sha256"), "receipt_id").join(subtotal.withColumnRenamed("month", "__m"), F.col("month").eqNullSafe(F.col("__m"))).drop("__m")
    return page.select("receipt_id", "sha256", "merchant", "purchased_on", "category", "status", "total_cents", "month", "month_cents").orderBy(F.desc_nulls_last("purchased_on"), F.desc("receipt_id"))


def months_present(transactions: DataFrame, day: str = "purchased_on") -> DataFrame:
    return transactions.filter(F.col(day).isNotNull()).select(month_key(F.col(day)).alias("month")).distinct().orderBy(F.desc("month"))


def health(transactions: DataFrame, as_of: str) -> DataFrame:
    """One pass: how many receipts by status, and this month's trusted total."""
    live = ~F.col("deleted")
    trusted = live & F.col("status").isin("ok", "needs_review") & (month_key(F.col("purchased_on")) == month_key(_as_of(as_of)))
    return transactions.agg(*[F.count_if(live & (F.col("status") == s)).alias(s) for s in ("ok", "needs_review", "pending", "failed")], F.count(F.lit(1)).alias("receipts"), F.coalesce(F.sum(F.when(trusted, F.col("total_cents"))), F.lit(0)).alias("month_cents"))


def feed_counters(bank: DataFrame) -> DataFrame:
    return bank.agg(F.count(F.lit(1)).alias("transactions"), F.count_if("pending").alias("pending"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if("duplicate_suspect").alias("duplicate_suspects"), F.count_if("amount_changed").alias("amount_changed"))


def feed_health(polls: DataFrame, as_of: str) -> DataFrame:
    ok = F.when(F.col("outcome").isin("ok", "partial"), F.col("started_at"))
    failed = F.col("outcome") == "error"
    out = polls.groupBy("source").agg(F.max(ok).alias("last_ok"), F.max_by(F.when(failed, F.col("note")), F.when(failed, F.struct("started_at", "uid"))).alias("last_error"), F.count(F.lit(1)).alias("polls"), F.bool_or(needs_a_human(F.col("errors"))).alias("needs_a_human"))
    return out.withColumn("stale_days", F.datediff(_as_of(as_of), F.to_date("last_ok")))


def stale_accounts(accounts: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    return accounts.filter(F.col("last_seen_at") < F.date_sub(_as_of(as_of), days).cast("timestamp")).select("account_key", "last_seen_at", F.datediff(_as_of(as_of), F.to_date("last_seen_at")).alias("days"))


def polls_since(polls: DataFrame, built_at: str) -> DataFrame:
    return polls.filter(F.col("started_at") > F.lit(built_at).cast("timestamp")).agg(F.count(F.lit(1)).alias("polls"))


def poll_history(polls: DataFrame, records: DataFrame, n: int = 20, source: str | None = None) -> DataFrame:
    """The newest n polls with how many records each brought in."""
    if source:
        polls = polls.filter(F.col("source") == source)
    newest = polls.orderBy(F.desc("started_at"), F.desc("uid")).limit(n)
    new = records.groupBy(F.col("poll_uid").alias("uid")).agg(F.count(F.lit(1)).alias("n_new"))
    return newest.join(new, "uid", "left").select("uid", "source", "outcome", "started_at", F.coalesce("n_new", F.lit(0)).alias("n_new")).orderBy(F.desc("started_at"), F.desc("uid"))


def account_report(accounts: DataFrame) -> DataFrame:
    return accounts.orderBy(F.desc("unmapped"), "account_key")


def month_filter(bank: DataFrame, month: str) -> DataFrame:
    """Rows of one month, as a date range, so files prune."""
    first = F.lit(f"{month}-01").cast("date")
    return bank.filter((F.col("date") >= first) & (F.col("date") < F.add_months(first, 1)))

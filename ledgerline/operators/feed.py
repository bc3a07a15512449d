"""Bank observations into one row a transaction, with an additive measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import local_date
from ledgerline.functions.money import inflow, outflow
from ledgerline.functions.text import merchant_key, merchant_name, truthy
from ledgerline.operators.observations import collapsed, edit, edited, last_edits
from ledgerline.rules import UNMAPPED, Rules
from ledgerline.schemas import COST_FLOWS, FEED_FIELDS, FLOWS, OUTGO
from ledgerline.storage import once


def structural_flow(amount: Column, kind: Column) -> Column:
    """What sign and account kind imply when nothing else says."""
    return F.when(amount.isNull(), "unknown").when(amount < 0, OUTGO).when(kind == "credit", "refund").when(kind.isin("checking", "savings"), "income").otherwise("unknown")


def with_accounts(rows: DataFrame, rules: Rules, native: str = "native_account") -> DataFrame:
    """Adds account_key, account_name, kind, institution, unmapped. The named accounts are a rule file, so they are broadcast."""
    named = rules.accounts.table(rows.sparkSession).withColumnsRenamed({"native": "__native", "display_name": "account_name"})
    out = rows.join(F.broadcast(named), F.col(native) == F.col("__native"), "left")
    unmapped = F.col("__native").isNull()
    return out.withColumns({"unmapped": unmapped, "account_key": F.coalesce("account_key", F.concat(F.lit(UNMAPPED), native)), "kind": F.coalesce("kind", F.lit("other"))}).drop("__native")


def status_of(unmapped: Column) -> tuple[Column, Column]:
    """(status, review_reason), the first that holds."""
    deleted, amount = F.col("deleted"), F.col("amount_cents")
    ladder = [
        (deleted, "ignored", F.lit("deleted")),
        (amount.isNull(), "needs_review", F.concat(F.lit("amount unparseable: "), F.coalesce(F.nullif(F.col("reject_reason"), F.lit("")), F.lit("unknown")))),
        (unmapped, "needs_review", F.concat(F.col("native_account"), F.lit(" is not named in accounts.toml"))),
        (F.col("dated_on").isNull(), "needs_review", F.lit("no date")),
        (F.coalesce("pending", F.lit(False)), "pending", F.lit(None).cast("string")),
    ]
    status, reason = F.when(ladder[0][0], F.lit(ladder[0][1])), F.when(ladder[0][0], ladder[0][2])
    for test, name, why in ladder[1:]:
        status, reason = status.when(test, F.lit(name)), reason.when(test, why)
    return status.otherwise("ok"), reason


def project_feed(records: DataFrame, corrections: DataFrame, rules: Rules) -> DataFrame:
    """Newest observation, then hand edits, rules, source hints and structure, in that order of weight."""
    rows = with_accounts(collapsed(records), rules)
    edits = last_edits(corrections, "txn_key", FEED_FIELDS, ["created_at", "uid"])
    rows = rows.join(edits, "txn_key", "left")
    description = F.coalesce("description", F.lit(""))
    manual_flow = F.when(edit("flow").isin(*FLOWS), edit("flow"))
    rows = rows.withColumns({
        "description": description,
        "currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")),
        "posted_on": local_date(F.col("posted_at"), rules.tz),
        "transacted_on": local_date(F.col("transacted_at"), rules.tz),
        "pending": F.coalesce("pending", F.lit(False)),
        "deleted": truthy(F.col("edit_deleted")["value"]),
        "merchant": F.when(edited("merchant"), edit("merchant")).otherwise(F.coalesce(F.nullif("payee", F.lit("")), merchant_name(description, rules.merchants.match_spaced(description)))),
    })
    rows = rows.withColumns({
        "dated_on": F.coalesce("transacted_on", "posted_on"),
        "merchant_key": merchant_key(F.col("merchant")),
        "flow": F.coalesce(manual_flow, rules.flows.match_spaced(F.col("description")), F.nullif("flow_hint", F.lit("")), structural_flow(F.col("amount_cents"), F.col("kind"))),
        "category": F.when(edited("category"), edit("category")).otherwise(rules.categories.match(F.col("merchant"))),
    })
    counts = F.col("flow").isin(*COST_FLOWS) & ~F.col("deleted") & F.col("amount_cents").isNotNull()
    status, reason = status_of(F.col("unmapped"))
    rows = rows.withColumns({
        "outflow_cents": outflow(F.col("amount_cents")),
        "inflow_cents": inflow(F.col("amount_cents")),
        "counts_as_cost": counts,
        "net_cost_cents": F.when(counts, -F.col("amount_cents")).otherwise(F.lit(0)),
        "status": status,
        "review_reason": reason,
    })
    return rows.select(
        "txn_key", "account_key", "account_name", "kind", "institution", "source", "native_account", "external_id", F.col("uid").alias("record_uid"), "posted_on", "transacted_on", "dated_on", "pending", "currency", "amount_cents",
        "outflow_cents", "inflow_cents", "net_cost_cents", "counts_as_cost", "description", "merchant", "merchant_key", "category", "flow", "status", "review_reason", "first_seen_at", "last_seen_at", "revisions", "amount_changed", "deleted", "unmapped",
    )


#: What a row's flag follows from.
FLAG_READS = ("txn_key", "native_account", "account_key", "dated_on", "amount_cents", "merchant_key")


def mark_duplicates(rows: DataFrame, written: bool = True, rules: Rules | None = None) -> DataFrame:
    """duplicate_suspect: same account, day, amount and merchant as an earlier-keyed row of another native account.

    The first row of a fingerprint is an aggregate joined back, so a fingerprint that many rows share is
    summed before it is shuffled, and the join's hot side can be split. Rows without day or amount are never flagged.
    rows are evaluated once, into the shared folder. Where they aren't written, who doesn't read the flag has no join
    either: its keys are the aggregate's own, so it neither drops nor repeats a row, and it is left out of the plan.

    With rules that rows were projected by, only rows of accounts that several native accounts share are compared: those of
    another account are all of one native account, so none has a row of another one before it.
    """
    shared = None if rules is None else rules.accounts.shared()
    if shared == []:
        return rows.withColumn("duplicate_suspect", F.lit(False))
    if written:
        rows = once(rows, "feed-rows")
    keys = ["account_key", "dated_on", "amount_cents", "merchant_key"]
    usable = F.col("dated_on").isNotNull() & F.col("amount_cents").isNotNull()
    if shared:
        usable = usable & F.coalesce(F.col("account_key").isin(*shared), F.lit(False))
    fingerprint = F.struct(*keys)  # equal structs may hold nulls
    first = rows.filter(usable).groupBy(fingerprint.alias("__same")).agg(F.min_by("native_account", "txn_key").alias("__first"))
    out = rows.withColumn("__own", F.when(usable, fingerprint)).join(first, F.col("__own") == F.col("__same"), "left")
    return out.withColumn("duplicate_suspect", usable & F.coalesce(F.col("__first") != F.col("native_account"), F.lit(False))).select(*rows.columns, "duplicate_suspect")


def project_accounts(observations: DataFrame, transactions: DataFrame, rules: Rules) -> DataFrame:
    """One row an account: attributes from its first native id, balance from the newest observation, coverage from dated rows."""
    newest = observations.groupBy("source", "native_id").agg(F.max_by(F.struct("name", "org_name", "currency", "balance_cents", "balance_at", "observed_at"), F.struct("observed_at", "uid")).alias("o")).select("source", "native_id", "o.*")
    named = with_accounts(newest, rules, "native_id")
    order = F.struct("source", "native_id")
    first = lambda c: F.min_by(F.struct(c.alias("v")), order)["v"]
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("source", "native_id"))), lambda x: x[c]))
    rolled = named.groupBy("account_key").agg(
        first(F.coalesce("account_name", F.nullif("name", F.lit("")), "account_key")).alias("display_name"), first(F.col("kind")).alias("kind"), first(F.coalesce("institution", "org_name")).alias("institution"),
        first(F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))).alias("currency"), ordered("source").alias("sources"), ordered("native_id").alias("native_ids"),
        F.max_by(F.struct("balance_cents", "balance_at", "observed_at"), F.struct("observed_at", "source", "native_id")).alias("b"),
        F.max_by("balance_cents", F.when(F.col("balance_cents").isNotNull(), F.struct("observed_at", "source", "native_id"))).alias("last_known_balance_cents"), first(F.col("unmapped")).alias("unmapped"),
    )
    covers = transactions.filter("dated_on is not null").groupBy("account_key").agg(F.min("dated_on").alias("covers_from"), F.max("dated_on").alias("covers_to"))
    return rolled.join(covers, "account_key", "left").select("account_key", "display_name", "kind", "institution", "currency", "sources", "native_ids", "b.balance_cents", "b.balance_at", F.col("b.observed_at").alias("last_seen_at"), "last_known_balance_cents", "covers_from", "covers_to", "unmapped")

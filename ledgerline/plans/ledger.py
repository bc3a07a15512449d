"""One object over the truth tables: projections, views, named and ad-hoc queries, publication."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.feed import FLAG_READS, mark_duplicates, project_accounts, project_feed
from ledgerline.operators.observations import deduplicated
from ledgerline.operators.receipts import project_receipts
from ledgerline.plans import reports, views
from ledgerline.rules import Rules
from ledgerline.schemas import BANK, EXTRACTIONS, RECEIPT_LEDGER, RECEIPTS
from ledgerline.operators import edits
from ledgerline.sources import polls as feed_polls
from ledgerline.sources import sinks
from ledgerline.sources.snapshots import Store
from ledgerline.storage import once


class Ledger:
    """Truth tables in, everything else derived. Nothing is computed before it is asked for."""

    def __init__(self, spark: SparkSession, rules: Rules, records: DataFrame, feed_corrections: DataFrame, feed_accounts: DataFrame, polls: DataFrame, receipts: DataFrame, extractions: DataFrame, corrections: DataFrame):
        self.spark, self.rules, self._written = spark, rules, False
        self.records, self.feed_corrections, self.feed_accounts, self.polls = records, feed_corrections, feed_accounts, polls
        self.receipts, self.extractions, self.corrections = receipts, extractions, corrections

    @classmethod
    def of(cls, store: Store, rules: Rules) -> Ledger:
        """The ledger over a store's truth tables, all as of one version."""
        at, tables = store.version(), feed_polls.SCHEMAS | edits.SCHEMAS | {"receipts": RECEIPTS, "extractions": EXTRACTIONS}
        t = {name: store.table(name, schema, at=at) for name, schema in tables.items()}
        return cls(store.spark, rules, t["feed_records"], t["feed_corrections"], t["feed_accounts"], t["feed_polls"], t["receipts"], t["extractions"], t["corrections"])

    @cached_property
    def feed_rows(self) -> DataFrame:
        """Feed transactions without duplicate_suspect, which takes a join of the projection with itself."""
        return project_feed(deduplicated(self.records), self.feed_corrections, self.rules)

    @cached_property
    def feed_transactions(self) -> DataFrame:
        return mark_duplicates(self.feed_rows, written=not self._written, rules=self.rules)

    def flagged(self, *columns: str) -> DataFrame:
        """These columns and duplicate_suspect; no others are evaluated, nor written for the flag."""
        read = self.feed_rows.select(*dict.fromkeys((*FLAG_READS, *columns)))
        return mark_duplicates(read, written=not self._written, rules=self.rules).select(*columns, "duplicate_suspect")

    @cached_property
    def accounts(self) -> DataFrame:
        return project_accounts(self.feed_accounts, self.feed_rows, self.rules)

    @cached_property
    def _receipts(self) -> tuple[DataFrame, DataFrame]:
        return project_receipts(self.receipts, self.extractions, self.corrections, self.rules)

    @property
    def receipt_transactions(self) -> DataFrame:
        return self._receipts[0]

    @property
    def items(self) -> DataFrame:
        return self._receipts[1]

    @cached_property
    def bank(self) -> DataFrame:
        return views.bank(self.feed_transactions)

    @cached_property
    def unflagged(self) -> DataFrame:
        """bank without duplicate_suspect, for reports that don't read it."""
        return views.bank(self.feed_rows).drop("duplicate_suspect")

    @cached_property
    def receipt_rows(self) -> DataFrame:
        return views.receipts(self.receipt_transactions, self.rules)

    def register(self) -> None:
        """Views of SQL; nothing is evaluated for columns that a query doesn't read."""
        views.register(views.bank(mark_duplicates(self.feed_rows, written=False, rules=self.rules)), self.receipt_rows, reports.balances(self.accounts), self.items, self.polls)

    @cached_property
    def _evaluated(self) -> Ledger:
        out = copy(self)
        for derived in ("feed_transactions", "accounts", "bank", "unflagged", "receipt_rows", "_evaluated"):
            out.__dict__.pop(derived, None)
        out.feed_rows, out._written = once(self.feed_rows, "feed-rows"), True
        transactions, items = project_receipts(self.receipts, self.extractions, self.corrections, self.rules, once)
        out._receipts = (once(transactions, "receipt-rows"), items)
        return out

    def evaluated(self) -> Ledger:
        """This ledger with its projections written to the shared folder once, for many reports and publications."""
        return self._evaluated

    def named(self, as_of: str) -> dict[str, Callable[[], DataFrame]]:
        """The canned reports by name."""
        s = views.costs(self.unflagged)
        return {
            "monthly-by-category": lambda: reports.monthly_by_category(s), "top-merchants": lambda: reports.top_merchants(s, as_of), "month-over-month": lambda: reports.month_over_month(s, as_of), "recurring": lambda: reports.recurring(s, as_of),
            "unusual": lambda: reports.unusual(s, as_of), "pending-and-restated": lambda: reports.pending_and_restated(self.unflagged), "balances": lambda: reports.balances(self.accounts), "receipt-candidates": lambda: reports.receipt_candidates(self.receipt_rows, s),
        }

    def sql(self, query: str, as_of: str = "2001-08-01", **args) -> DataFrame:
        """A named query, a path to a file with SQL, or SQL text over the published views."""
        named = self.named(as_of)
        if query in named:
            return named[query]()
        self.register()
        text = Path(query).read_text() if query.endswith(".sql") and Path(query).exists() else query
        return self.spark.sql(text, args=args or None)

    def correct(self, store: Store, changes: DataFrame, at: str) -> dict[str, int]:
        """Append hand edits of receipts, (receipt_id, field, value), made at an instant; returns how many were {recorded, unchanged, refused}.

        An edit that says what the projection already shows isn't recorded, and one of a receipt that isn't there is refused.
        """
        judged = once(edits.judged(changes, self.receipt_transactions), "edits")
        store.append_new({"corrections": edits.as_corrections(judged, at)}, edits.KEYED)
        return {r["verdict"]: r["n"] for r in judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}

    def correct_feed(self, store: Store, changes: DataFrame, at: str) -> int:
        """Append hand edits of transactions, (txn_key, field, value); other fields than those that may be edited are left out."""
        return store.append_new({"feed_corrections": edits.as_feed_corrections(changes, at)}, edits.KEYED)["feed_corrections"]

    def publish(self, path: str, compression: str = "none") -> None:
        """Ledger tables, month files, manifest and documentation under path, all of them in one commit.

        Each projection is evaluated once, however often it is published. Readers have the last publication until this one is
        whole, and keep it if it fails. compression (gzip) is that of the month files, text of five to ten times its size.
        """
        own, store = self.evaluated(), Store(self.spark, path)
        build, tables = store.new_build(), {"bank": own.bank, "receipts": own.receipt_rows, "items": own.items, "accounts": own.accounts}
        staged = {name: store.stage(name, df) for name, df in tables.items()}
        bank, receipts = (store.staged(staged[name]) for name in ("bank", "receipts"))  # months and manifest are of the rows as staged
        if not sinks.broken(receipts, "net_cost_cents = 0").isEmpty():
            raise ValueError("a receipt has a measure other than 0")
        sinks.write_months(bank, f"{build}/bank", as_told=views.match_struct, compression=compression)
        sinks.write_months(receipts, f"{build}/receipts", compression=compression)
        sinks.manifest(bank, receipts, own.polls).write.json(f"{build}/manifest")
        doc = sinks.documentation({"bank": BANK, "receipts": RECEIPT_LEDGER})
        self.spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{build}/schema")
        store.replace(build=build, **staged)

"""Projections, sources, sinks, schedule and reports on small tables."""

from __future__ import annotations

import json
from copy import copy
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas, storage
from ledgerline.functions.ids import content_hash, txn_key
from ledgerline.operators import feed, observations
from ledgerline.operators.receipts import project_receipts, work_queue
from ledgerline.plans import catalogue, reports, schedule, views
from ledgerline.plans.ledger import Ledger
from ledgerline.rules import Accounts, Ordered, Rules
from ledgerline.sources import feed as feed_source
from ledgerline.sources import sinks, statements
from ledgerline.sources.polls import KEYED
from ledgerline.sources.snapshots import Store
from ledgerline.streaming import ingest

RULES = Rules(
    categories=Ordered((("groceries", ("key food",)), ("restaurant", ("coffee", "food")))), merchants=Ordered((("Whole Foods", ("wholefds",)),)), flows=Ordered((("payment", ("autopay pymt",)), ("fee", ("late fee",)))),
    accounts=Accounts((("card", {"name": "Card", "kind": "credit", "native": ["A", "B"]}), ("checking", {"kind": "checking", "native": ["C"]}))), tz="America/New_York",
)


def at(day, hour=0):
    return datetime(2026, 8, day, hour)


def record(native="A", external="1", amount=-500, day="2026-08-14", description="KEY FOOD #12", observed=at(15), pending=False, **more):
    row = {"source": "simplefin", "native_account": native, "external_id": external, "posted_at": day, "transacted_at": None, "pending": pending, "amount_cents": amount, "currency": "USD", "description": description, "payee": None, "memo": None, "flow_hint": None, "reject_reason": None, "observed_at": observed, "poll_uid": None}
    return row | more


def records(spark, rows):
    df = schemas.shaped(spark.createDataFrame([tuple({f.name: None for f in schemas.FEED_RECORDS.fields} | r | {"uid": None, "content_sha256": None}) and tuple((({f.name: None for f in schemas.FEED_RECORDS.fields}) | r)[f.name] for f in schemas.FEED_RECORDS.fields) for r in rows], schemas.FEED_RECORDS), schemas.FEED_RECORDS)
    df = df.withColumn("content_sha256", content_hash())
    return df.withColumn("uid", F.sha2(F.concat_ws("|", "source", "native_account", "external_id", "content_sha256"), 256))


def corrections(spark, rows):
    key = lambda n, e: spark.range(1).select(txn_key(F.lit("simplefin"), F.lit(n), F.lit(e)).alias("k")).first()["k"]
    return spark.createDataFrame([(f"c{i}", key(n, e), f, v, at(20, i)) for i, (n, e, f, v) in enumerate(rows)], schemas.FEED_CORRECTIONS)


def project(spark, rows, edits=()):
    df = feed.mark_duplicates(feed.project_feed(observations.deduplicated(records(spark, rows)), corrections(spark, edits), RULES))
    return {(r["native_account"], r["external_id"]): r for r in df.collect()}


def test_newest_observation_wins_and_revisions_count(spark):
    got = project(spark, [record(amount=-5200, pending=True, observed=at(14)), record(amount=-6100, observed=at(15)), record(amount=-6100, observed=at(16))])["A", "1"]
    assert (got["amount_cents"], got["revisions"], got["amount_changed"], got["pending"], got["net_cost_cents"]) == (-6100, 2, True, False, 6100)


def test_transactions_are_shuffled_once(spark):
    rows = [record(amount=a, observed=at(d), external=e) for a, d, e in ((-5, 2, "1"), (-5, 1, "1"), (-6, 3, "1"), (-5, 4, "1"), (-7, 1, "2"))] + [record(external="3", observed=None), record(external="3", observed=at(2), amount=None)]
    df = observations.collapsed(observations.deduplicated(records(spark, rows)))
    got = {r["external_id"]: (r["amount_cents"], r["first_seen_at"], r["last_seen_at"], r["revisions"], r["amount_changed"]) for r in df.collect()}
    assert got == {"1": (-6, at(1), at(3), 2, True), "2": (-7, at(1), at(1), 1, False), "3": (None, at(2), at(2), 2, False)}
    edited = df.join(observations.last_edits(corrections(spark, [("A", "1", "category", "fuel")]).hint("shuffle_merge"), "txn_key", ("category",), ["created_at", "uid"]).hint("shuffle_merge"), "txn_key", "left")
    plan = edited.select("txn_key", "amount_cents", "edit_category")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_listed_ids_are_counted_without_arrays(spark):
    rows = [("p", "A", "1"), ("p", "A", "1"), ("p", "A", "2"), ("p", "B", "1"), ("q", "A", None), ("q", "A", "3"), ("r", "C", None)]
    df = spark.createDataFrame(rows, "poll_uid string, native_account string, external_id string")
    seen = observations.seen_ids(df).select("poll_uid", F.explode("seen").alias("native_account", "ids")).select("poll_uid", "native_account", F.size("ids")).collect()
    assert sorted(map(tuple, observations.listed_ids(df).collect())) == sorted(map(tuple, seen)) == [("p", "A", 2), ("p", "B", 1), ("q", "A", 1), ("r", "C", 0)]
    query = catalogue.QUERIES["a19_seen_ids"](spark, "/root/testdata/sf0.001")
    assert "collect_set" not in query._jdf.queryExecution().toString()


def test_flows_and_measure(spark):
    rows = [record(external="out"), record(external="refund", amount=300), record("C", "income", 900), record(external="pay", amount=9000, description="CAPITAL ONE    AUTOPAY   PYMT"), record(external="bad", amount=None, reject_reason="no digits in 'x'"), record("Z", "unmapped", -100), record(external="undated", day=None), record(external="pending", pending=True)]
    got = project(spark, rows)
    assert {e: (r["flow"], r["status"], r["net_cost_cents"]) for (_, e), r in got.items()} == {
        "out": (schemas.OUTGO, "ok", 500), "refund": ("refund", "ok", -300), "income": ("income", "ok", 0), "pay": ("payment", "ok", 0), "bad": ("unknown", "needs_review", 0), "unmapped": (schemas.OUTGO, "needs_review", 100), "undated": (schemas.OUTGO, "needs_review", 500), "pending": ("spend", "pending", 500),
    }
    assert got["A", "bad"]["outflow_cents"] is None and got["A", "bad"]["review_reason"] == "amount unparseable: no digits in 'x'"
    assert all((r["outflow_cents"] or 0) * (r["inflow_cents"] or 0) == 0 for r in got.values())
    assert sum(r["net_cost_cents"] for r in got.values()) == sum(r["net_cost_cents"] for r in got.values() if r["counts_as_cost"])


def test_edits_outweigh_rules_and_may_clear(spark):
    rows = [record(external=str(i)) for i in range(4)]
    got = project(spark, rows, [("A", "0", "category", "fuel"), ("A", "0", "category", "services"), ("A", "1", "category", None), ("A", "2", "deleted", "yes"), ("A", "3", "merchant", "Coffee Spot"), ("A", "3", "flow", "nonsense")])
    assert [got["A", str(i)]["category"] for i in range(4)] == ["services", None, "groceries", "restaurant"]
    assert (got["A", "2"]["status"], got["A", "2"]["net_cost_cents"], got["A", "2"]["counts_as_cost"]) == ("ignored", 0, False)
    assert (got["A", "3"]["merchant_key"], got["A", "3"]["flow"]) == ("coffee spot", schemas.OUTGO)


def test_duplicates_across_native_accounts(spark):
    got = project(spark, [record("A", "1"), record("B", "9"), record("A", "2", -700), record("A", "3", -700), record("B", "4", None)])
    assert sorted(r["duplicate_suspect"] for (n, e), r in got.items() if e in ("1", "9")) == [False, True]
    assert not any(r["duplicate_suspect"] for (n, e), r in got.items() if e in ("2", "3", "4"))


def test_partitions_and_repeats_do_not_matter(spark):
    rows = [record(external=str(i % 5), amount=-100 * i, observed=at(1 + i)) for i in range(15)]
    assert project(spark, rows) == project(spark, rows[::-1] + rows)


def test_accounts(spark):
    rows = [("u1", "drop", "A", "a", "Bank", "USD", 100, None, at(1), at(1)), ("u2", "simplefin", "B", "b", "Bank", "USD", 200, None, at(2), at(2)), ("u3", "drop", "A", "a", "Bank", "USD", None, None, None, at(3)), ("u4", "drop", "Z", "z", "Bank", None, 5, None, at(1), at(1))]
    txns = spark.createDataFrame([("card", date(2026, 8, 1)), ("card", date(2026, 8, 9)), ("card", None)], "account_key string, dated_on date")
    got = {r["account_key"]: r for r in feed.project_accounts(spark.createDataFrame(rows, schemas.FEED_ACCOUNTS), txns, RULES).collect()}
    card = got["card"]
    assert (card["display_name"], card["sources"], card["native_ids"], card["balance_cents"], card["last_known_balance_cents"], card["covers_from"], card["covers_to"]) == ("Card", ["drop", "simplefin"], ["A", "B"], None, 200, date(2026, 8, 1), date(2026, 8, 9))
    assert got["unmapped:Z"]["unmapped"] and got["unmapped:Z"]["currency"] == "USD"


PAYLOAD = {"merchant": "Key Food", "purchased_on": "2026-08-14", "currency": "usd", "total": "5.00", "tax": "0.50", "category": "fuel", "line_items": [{"description": "Milk", "qty": "1", "unit_price": "4.50", "total": "4.50"}]}


def receipts_of(spark, attempts, edits=()):
    n = max([a[0] for a in attempts] + [e[0] for e in edits] + [0])
    receipts = spark.createDataFrame([(i, str(i), "upload", at(1)) for i in range(n + 1)], schemas.RECEIPTS)
    ext = spark.createDataFrame([(k, r, s, p, note, at(2, k)) for k, (r, s, p, note) in enumerate(attempts)], schemas.EXTRACTIONS)
    cor = spark.createDataFrame([(k, r, f, v, at(3, k)) for k, (r, f, v) in enumerate(edits)], schemas.CORRECTIONS)
    t, items = project_receipts(receipts, ext, cor, RULES)
    return {r["receipt_id"]: r for r in t.collect()}, items.orderBy("receipt_id", "line_no").collect(), work_queue(receipts, ext)


def test_receipt_ladder(spark):
    attempts = [(0, "error", None, "timeout"), (1, "ok", json.dumps(PAYLOAD), None), (2, "ok", json.dumps(PAYLOAD | {"total": "9.99"}), None), (3, "ok", json.dumps(PAYLOAD | {"merchant": None}), None), (4, "ok", None, None)]
    got, _, queue = receipts_of(spark, attempts, [(5, "note", "x")])
    assert {k: (r["status"], r["review_reason"]) for k, r in got.items()} == {0: ("failed", "timeout"), 1: ("ok", None), 2: ("needs_review", "items + tax + tip = 5.00, receipt says 9.99"), 3: ("needs_review", "missing merchant"), 4: ("pending", "no usable extraction"), 5: ("pending", "not extracted yet")}
    assert got[1]["category"] == "groceries" and got[3]["category"] == "fuel"
    assert {r["receipt_id"] for r in queue.collect()} == {0, 5}


def test_item_patches(spark):
    edits = [(0, "item.3.description", "Bread"), (0, "item.3.total", "1.00"), (0, "item.1.qty", "2"), (0, "item.0.qty", "9"), (0, "item.1.qty", "3"), (0, "total", "6.00"), (0, "category", None)]
    got, items, _ = receipts_of(spark, [(0, "ok", json.dumps(PAYLOAD), None)], edits)
    assert [(i["line_no"], i["description"], i["qty"], i["total_cents"]) for i in items] == [(1, "Milk", "3", 450), (2, "Bread", None, 100)]
    assert (got[0]["status"], got[0]["category"]) == ("ok", None)


def test_item_patches_with_large_numbers_and_long_reports(spark):
    edits = [(0, "item.10001.description", "Bread"), (0, "item.10001.total", "1.00"), (0, "item.3000000000.description", "Salt")]
    _, items, _ = receipts_of(spark, [(0, "ok", json.dumps(PAYLOAD), None)], edits)
    assert [(i["line_no"], i["description"]) for i in items][-2:] == [(len(items) - 1, "Bread"), (len(items), "Salt")]
    assert len(sinks.render(spark.range(1500)).splitlines()) == 1501 == len(sinks.render(spark.range(1501), as_json=True).splitlines())
    assert sinks.render(spark.range(5), most=2).splitlines()[1:] == ["0", "1", "(3 more rows)"]


def test_manual_receipt_without_extraction(spark):
    got, _, _ = receipts_of(spark, [], [(0, "merchant", "Key Food"), (0, "total", "3"), (0, "purchased_on", "2026-08-01")])
    assert (got[0]["status"], got[0]["total_cents"]) == ("ok", 300)


CREDIT = "Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit\n2026-08-14,2026-08-15,4471,KEY FOOD,x,5.00,\n2026-08-14,2026-08-15,4471,REFUND,x,,2.00\n,,,,,,\n"
OFX = "OFXHEADER:100\n<ACCTID>000123456\n<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260814120000[-5:EST]<TRNAMT>-12.34<FITID>f1<NAME>SHOP</STMTTRN><STMTTRN><DTPOSTED>20260815<TRNAMT>oops<NAME>BAD</STMTTRN>"


def test_statements(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + CREDIT, encoding="utf-8")
    rows = sorted(statements.records(statements.read_csv(spark, str(tmp_path / "a.csv")), F.lit(at(16))).collect(), key=lambda r: r["amount_cents"])
    assert [(r["native_account"], r["posted_at"], r["amount_cents"]) for r in rows] == [("drop:capitalone-credit:4471", "2026-08-15", -500), ("drop:capitalone-credit:4471", "2026-08-15", 200)]
    (tmp_path / "b.ofx").write_text(OFX)
    parsed = statements.read_ofx(spark, str(tmp_path / "b.ofx"))
    got = {r["description"]: r for r in parsed.collect()}
    assert (got["SHOP"]["native_account"], got["SHOP"]["external_id"], got["SHOP"]["posted_at"], got["SHOP"]["amount_cents"]) == ("drop:ofx:3456", "f1", "2026-08-14", -1234)
    assert got["BAD"]["reject_reason"] == "no digits in 'oops'"
    assert statements.outcomes(parsed).first()["outcome"] == "partial"
    seen = statements.unclaimed(spark, str(tmp_path), spark.createDataFrame([], "file_sha256 string"))
    assert seen.count() == 2 and statements.unclaimed(spark, str(tmp_path), seen).count() == 0
    with pytest.raises(statements.UnknownFormat):
        statements.sniff(["Date", "Amount"])


def test_feed_payload(spark):
    body = json.dumps({"errlist": [{"code": "con.auth", "msg": "m"}], "accounts": [{"id": "A", "name": "Card", "balance": "10.00", "balance-date": 1786700000, "transactions": [{"id": "1", "posted": 1786700000, "amount": "-5.00", "description": "X"}, {"id": "2", "posted": 0, "amount": "-1.00", "description": "Y"}, {"id": "", "amount": "1"}]}]})
    parsed = feed_source.parse(spark.createDataFrame([("p", "simplefin", at(1), body)], "poll_uid string, source string, observed_at timestamp, body string"))
    assert sorted((r["external_id"], r["amount_cents"], r["pending"]) for r in feed_source.records(parsed).collect()) == [("1", -500, False), ("2", -100, True)]
    assert feed_source.accounts(parsed).first()["balance_cents"] == 1000 and feed_source.errors(parsed).first()["code"] == "con.auth"


def polls(spark, spans, started=()):
    rows = [(str(i), "s", "ok", datetime(2026, 1, 1), a, b, None, "[]", None) for i, (a, b) in enumerate(spans)] + [(f"x{i}", "s", "error", t, None, None, None, "[]", None) for i, t in enumerate(started)]
    return spark.createDataFrame(rows, schemas.FEED_POLLS)


def test_schedule(spark):
    today = date(2026, 8, 26)
    span = schedule.next_window(polls(spark, [], [at(1)]), "s", today)
    assert (span.start, span.end) == (date(2026, 5, 30), date(2026, 8, 27))
    hole = schedule.next_window(polls(spark, [(date(2026, 6, 1), date(2026, 7, 1)), (date(2026, 7, 10), date(2026, 8, 20))]), "s", today)
    assert (hole.start, hole.end) == (date(2026, 7, 1), date(2026, 7, 10))
    tail = schedule.next_window(polls(spark, [(date(2026, 5, 1), date(2026, 8, 20))]), "s", today)
    assert (tail.start, tail.end) == (date(2026, 8, 15), date(2026, 8, 27))
    assert schedule.next_window(polls(spark, [], [datetime(2026, 8, 26, i) for i in range(20)]), "s", today) is None
    far = polls(spark, [(date(2025, 12, 1), date(2025, 12, 5)), (date(2026, 1, 1), date(2026, 1, 9)), (date(2026, 1, 5), date(2026, 1, 7)), (date(2026, 1, 8), date(2026, 1, 20))])
    assert [tuple(r) for r in schedule.gaps(far).collect()] == [("s", date(2025, 12, 5), date(2026, 1, 1))]


@pytest.fixture(scope="module")
def book(spark):
    rows = [record(external=str(i), amount=-1000 - i, day=f"2026-0{m}-10", description="NETFLIX") for i, m in enumerate((4, 5, 6, 7))] + [record(external="big", amount=-20000, day="2026-08-01", description="LAMP STORE"), record(external="r", amount=-500)]
    ext = spark.createDataFrame([(0, 0, "ok", json.dumps(PAYLOAD), None, at(2))], schemas.EXTRACTIONS)
    return Ledger(spark, RULES, records(spark, rows), corrections(spark, []), spark.createDataFrame([], schemas.FEED_ACCOUNTS), polls(spark, []), spark.createDataFrame([(0, "s", "upload", at(1)), (1, "t", "upload", at(1))], schemas.RECEIPTS), ext, spark.createDataFrame([], schemas.CORRECTIONS))


def test_reports(spark, book):
    s = views.costs(book.bank)
    assert [tuple(r) for r in reports.recurring(s, "2026-08-20").collect()] == [("Netflix", 4, 1000, 1003, 1001)]
    assert [(r["merchant"], r["why"]) for r in reports.unusual(s, "2026-08-20").collect()] == [("Lamp Store", "first time here")]
    pairs = reports.receipt_candidates(book.receipt_rows, s).collect()
    assert [(r["kind"], r["merchant"]) for r in pairs] == [("candidate pair", "Key Food"), ("charge over $75 with no receipt", "Lamp Store")]
    assert book.sql("SELECT sum(net_cost_cents) AS c FROM everything").first()["c"] == 4006 + 20000 + 500
    assert "(no rows)" == sinks.render(book.sql("balances"))


def test_publish(spark, book, tmp_path):
    book.publish(str(tmp_path / "out"))
    book.publish(str(tmp_path / "out"))
    store = Store(spark, str(tmp_path / "out"))
    assert store.numbers() == [1, 2] and len(store.vacuum()) >= 5
    lines = [json.loads(x) for p in Path(store.build(), "bank/year=2026/month=08").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["date"] for x in lines] == ["2026-08-01", "2026-08-14"] and list(lines[0]) == sorted(lines[0])
    assert store.table("bank").count() == 6 and spark.read.json(f"{store.build()}/manifest").first()["bank_rows"] == 6
    assert schemas.unsafe_sums(schemas.BANK, ["amount_cents", "net_cost_cents"]) == ["amount_cents"]


def test_idempotent_appends_and_stream(spark, tmp_path):
    batch = records(spark, [record(external=str(i)) for i in range(3)])
    assert [Store(spark, str(tmp_path / "t")).append_new({"feed_records": batch}, KEYED) for _ in range(3)] == [{"feed_records": n} for n in (3, 0, 0)]
    batch.write.parquet(str(tmp_path / "in/a"))
    batch.write.parquet(str(tmp_path / "in/b"))
    q = ingest.append(ingest.observed(spark, str(tmp_path / "in/*"), 1), Store(spark, str(tmp_path / "s")), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert Store(spark, str(tmp_path / "s")).table("feed_records").count() == 3
    assert sinks.upserted(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string"), ["k"], ["v"]).first()["v"] == "b"


def test_manifest_does_not_write_the_flagged_rows(spark):
    query = catalogue.QUERIES["k9_manifest"](spark, "/root/testdata/sf0.001")
    assert "feed-rows" not in query._jdf.queryExecution().executedPlan().toString()


def test_sql_leaves_out_the_flag_that_it_does_not_read(spark, book, monkeypatch):
    """Registering the views wrote all rows for a flag that few queries read."""
    monkeypatch.setattr("ledgerline.operators.feed.once", None)
    sums = book.sql("SELECT account, sum(net_cost_cents) AS cents FROM costs GROUP BY account")
    assert "__first" not in sums._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.undo()
    flags = book.sql("SELECT id, duplicate_suspect FROM bank")
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, book.bank.select("id", "duplicate_suspect").collect())) != []


def _written(monkeypatch):
    """Columns of what once() writes, by name."""
    seen = {}
    for module in ("ledgerline.operators.feed", "ledgerline.plans.ledger"):
        monkeypatch.setattr(f"{module}.once", lambda df, name: (seen.setdefault(name, []).append(df.columns), storage.once(df, name))[1])
    return seen


def test_counters_write_only_what_the_flag_reads(spark, book, monkeypatch):
    """All of the projection's columns were written for a flag; those of other accounts than shared ones aren't even compared."""
    seen = _written(monkeypatch)
    got = reports.feed_counters(views.bank(book.flagged("deleted", "pending", "status", "amount_changed", "amount_cents"))).collect()
    assert got == reports.feed_counters(book.bank).collect()
    assert set(seen["feed-rows"][0]) == {*feed.FLAG_READS, "deleted", "pending", "status", "amount_changed"}
    seen.clear()
    query = catalogue.QUERIES["q13_feed_counters"](spark, "/root/testdata/sf0.001")
    assert not seen and "__first" not in query._jdf.queryExecution().optimizedPlan().toString()


def test_flags_of_shared_accounts_only(spark, monkeypatch):
    rows = [record("A", "1"), record("B", "9"), record("C", "1"), record("Z", "1"), record("A", "2", None), record("B", "3", day=None)]
    projected = feed.project_feed(observations.deduplicated(records(spark, rows)), corrections(spark, ()), RULES)
    assert RULES.accounts.shared() == ["card"] and Accounts((("unmapped:Z", {"native": ["Q"]}),)).shared() == ["unmapped:Z"]
    flags = lambda df: sorted(map(tuple, df.select("txn_key", "duplicate_suspect").collect()))
    assert flags(feed.mark_duplicates(projected, rules=RULES)) == flags(feed.mark_duplicates(projected)) and sum(f for _, f in flags(feed.mark_duplicates(projected))) == 1
    monkeypatch.setattr("ledgerline.operators.feed.once", None)
    alone = Rules(RULES.categories, RULES.merchants, RULES.flows, Accounts((("card", {"native": ["A"]}),)))
    assert not any(f for _, f in flags(feed.mark_duplicates(projected, rules=alone)))
    assert "txn_key" in catalogue.QUERIES["w4_duplicate_flag"](spark, "/root/testdata/sf0.001").columns  # nothing is written for it


def test_publishing_evaluates_once(spark, book, tmp_path, monkeypatch):
    """Rows were written three times a publication, and moved as lines of text; month files may be compressed."""
    seen, dealt, book = _written(monkeypatch), [], copy(book)
    book.__dict__.pop("_evaluated", None)
    monkeypatch.setattr(sinks, "write_months", lambda df, *a, plain=sinks.write_months, **k: (dealt.append(df.columns), plain(df, *a, **k)))
    for _ in range(2):
        book.publish(str(tmp_path / "out"), compression="gzip")
    assert {name: len(times) for name, times in seen.items()} == {"feed-rows": 1, "receipt-bases": 1, "items": 1, "receipt-rows": 1}
    assert dealt[0] == [f.name for f in schemas.BANK.fields]
    store = Store(spark, str(tmp_path / "out"))
    folder = Path(store.build(), "bank/year=2026/month=08")
    assert all(p.name.endswith(".gz") for p in folder.glob("part-*"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(folder)).collect()]
    assert [x["date"] for x in lines] == ["2026-08-01", "2026-08-14"] and lines[0]["match"]["date"] == "2026-08-01" and list(lines[0]) == sorted(lines[0])
    assert store.table("bank").count() == 6


def test_receipts_alone_are_an_anti_join(spark, book, monkeypatch):
    """They were filtered out of the whole report, with its names and its sort."""
    s = views.costs(book.unflagged)
    for cents in (2, 100_000):
        want = reports.receipt_candidates(book.receipt_rows, s, cents=cents).filter("kind = 'receipt with no candidate'")
        assert sorted(r["id"] for r in reports.receipts_alone(book.receipt_rows, s, cents=cents).collect()) == sorted(r["receipt"] for r in want.collect())
    assert reports.receipts_alone(book.receipt_rows, s.filter("false")).count() == book.receipt_rows.filter("total_cents is not null").count() > 0
    seen = []
    monkeypatch.setattr("ledgerline.plans.reports.once", lambda df, name: (seen.append(df.columns), storage.once(df, name))[1])
    plan = catalogue.QUERIES["j5_anti_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Sort [" not in plan and seen[1] == ["date", "merchant_key", "net_cost_cents"]

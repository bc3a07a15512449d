"""Commits: what readers see during one, what a crash leaves, what two writers get, what an append reads."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions.ids import content_hash
from ledgerline.operators import edits, observations, reconciliation, retention
from ledgerline.operators.lines import cluster_lines
from ledgerline.operators.receipts import retry_schedule
from ledgerline.plans import adapter
from ledgerline.plans.exchange import _delivered
from ledgerline.plans.ledger import Ledger
from ledgerline.sources import polls
from ledgerline.sources.snapshots import Conflict, Keyed, Store, month_of
from tests.test_ledger import RULES, at, record, records

K = {"t": Keyed(("k",), "k", ("v",), month_of("d"))}


def rows(spark, ids, month="2026-01"):
    return spark.createDataFrame([(str(i), i, f"{month}-02") for i in ids], "k string, v int, d string")


def test_readers_see_all_or_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        store.table("t")
    store.replace(t=rows(spark, range(5)), u=rows(spark, range(2)))
    before = store.table("t")
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the machine stops")))
        with pytest.raises(OSError, match="stops"):
            store.replace(t=rows(spark, range(50)), u=rows(spark, range(60)))
        with pytest.raises(OSError, match="stops"):
            store.append_new({"t": rows(spark, range(50))}, K)
    assert (store.table("t").count(), store.table("u").count(), store.numbers()) == (5, 2, [1])
    store.replace(t=rows(spark, range(7)), u=rows(spark, range(3)))
    assert (before.count(), store.table("t").count(), store.table("u").count(), store.table("t", at=store.version(1)).count()) == (5, 7, 3, 5)
    gone = store.vacuum()
    assert len(gone) == 4 + 1 and store.numbers() == [2] and store.table("t").count() == 7  # the staged leftovers and the first version


def test_two_writers_add_a_key_once(spark, tmp_path, monkeypatch):
    one, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.append_new({"t": rows(spark, range(3))}, K)
    plain, first = Store._publish, []

    def late(self, base, tables):
        if self is one and not first:
            first.append(other.append_new({"t": rows(spark, range(6))}, K))
        return plain(self, base, tables)

    monkeypatch.setattr(Store, "_publish", late)
    assert one.append_new({"t": rows(spark, range(4, 8))}, K) == {"t": 2} and first == [{"t": 3}]
    assert sorted(r["k"] for r in one.table("t").collect()) == [str(i) for i in range(8)]
    with pytest.raises(Conflict):
        plain(one, one.version(1), {})


def test_an_append_reads_its_months_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    read, plain = [], Store.table

    def noted(self, name, *a, **b):
        out = plain(self, name, *a, **b)
        read.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(Store, "table", noted)
    for m in range(1, 13):
        store.append_new({"t": rows(spark, range(100 * m, 100 * m + 80), f"2026-{m:02d}").coalesce(1)}, K)
    assert max(read) == 0  # new months: nothing to look at
    assert store.append_new({"t": rows(spark, range(1170, 1290), "2026-12").coalesce(1)}, K) == {"t": 40} and read[-1] == 1
    assert store.append_new({"t": rows(spark, range(1170, 1290), "2026-12").coalesce(1)}, K) == {"t": 0} and read[-1] == 2
    assert store.append_new({"t": rows(spark, [1171, 5000], "2026-12").coalesce(1)}, K) == {"t": 1} and read[-1] == 2
    assert store.table("t", months=["2026-03"]).count() == 80 and store.table("t").count() == 12 * 80 + 41
    for i in range(20):
        store.append_new({"t": rows(spark, [9000 + i], "2026-05").coalesce(1)}, K)
    count = store.table("t").count()
    store.tidy("t", K["t"])
    assert store.table("t").count() == count and len(store.table("t", months=["2026-05"]).inputFiles()) <= 4


def poll(spark, uid, started, outcome="ok"):
    return spark.createDataFrame([(uid, "drop", outcome, started, None, None, None, "[]", None)], schemas.FEED_POLLS)


def account(spark, uid, cents, seen):
    return spark.createDataFrame([(uid, "drop", "A", "a", "Bank", "USD", cents, None, seen, seen)], schemas.FEED_ACCOUNTS)


def test_record_a_poll(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    seen = records(spark, [record(external=str(i)) for i in range(28)])
    assert polls.record_poll(store, poll(spark, "p0", at(1)), account(spark, "a", 5, at(1)), seen) == {"feed_polls": 1, "feed_accounts": 1, "feed_records": 28}
    for night in range(3):  # polled again: an outcome each, nothing else
        again = records(spark, [record(external=str(i), observed=at(2 + night)) for i in range(28)])
        assert polls.record_poll(store, poll(spark, f"p{night + 1}", at(2 + night)), account(spark, "a", 5, at(2 + night)), again) == {"feed_polls": 1, "feed_accounts": 0, "feed_records": 0}
    failed = polls.record_poll(store, poll(spark, "p9", at(9), "error"), account(spark, "a", 5, at(9)).limit(0), seen.limit(0))
    assert failed == {"feed_polls": 1, "feed_accounts": 0, "feed_records": 0}
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the machine stops")))
        with pytest.raises(OSError, match="stops"):
            polls.record_poll(store, poll(spark, "p10", at(10)), account(spark, "b", 6, at(10)), records(spark, [record(external="new")]))
    assert [store.table(n).count() for n in ("feed_polls", "feed_accounts", "feed_records")] == [5, 1, 28]
    assert polls.record_poll(store, poll(spark, "p10", at(10)), account(spark, "b", 6, at(10)), records(spark, [record(external="new")])) == {"feed_polls": 1, "feed_accounts": 1, "feed_records": 1}
    book = Ledger.of(store, RULES)
    assert book.feed_rows.count() == 29 and book.receipt_transactions.count() == 0 and book.polls.count() == 6


def test_corrections(spark, tmp_path):
    import json

    store = Store(spark, str(tmp_path / "s"))
    payload = {"merchant": "Key Food", "purchased_on": "2026-08-14", "currency": "USD", "total": "5.00", "tax": None, "category": "fuel", "line_items": []}
    store.replace(receipts=spark.createDataFrame([(1, "s", "upload", at(1)), (2, "t", "upload", at(1))], schemas.RECEIPTS), extractions=spark.createDataFrame([(1, 1, "ok", json.dumps(payload), None, at(2))], schemas.EXTRACTIONS))
    changes = [
        (1, "merchant", "Key Food"), (1, "total", "$5"), (1, "tax", ""), (1, "tip", None), (1, "purchased_on", "2026-08-14"), (1, "deleted", ""), (1, "merchant_location", ""), (1, "category", "groceries"),
        (1, "currency", "EUR"), (1, "subtotal", "no number"), (1, "item.1.qty", "2"), (1, "nonsense", "x"), (3, "total", "1"), (2, "merchant", None), (2, "total", "3.00"), (2, "total", "3.00"), (None, "total", "3.00"),
    ]
    df = spark.createDataFrame(changes, "receipt_id long, field string, value string")
    judged = {(r["receipt_id"], r["field"]): r["verdict"] for r in edits.judged(df, Ledger.of(store, RULES).receipt_transactions).collect()}
    assert {k for k, v in judged.items() if v == "recorded"} == {(1, "currency"), (1, "subtotal"), (1, "item.1.qty"), (2, "total")}
    assert {k for k, v in judged.items() if v == "refused"} == {(1, "nonsense"), (3, "total"), (None, "total")}
    assert Ledger.of(store, RULES).correct(store, df, "2026-09-01 00:00:00") == {"recorded": 4, "unchanged": 9, "refused": 3}
    got = {r["receipt_id"]: r for r in Ledger.of(store, RULES).receipt_transactions.collect()}
    assert (got[1]["currency"], got[2]["total_cents"], got[1]["subtotal_cents"]) == ("EUR", 300, None)
    again = Ledger.of(store, RULES).correct(store, df, "2026-09-02 00:00:00")
    assert again["unchanged"] == 11 and store.table("corrections").count() == 6  # an unreadable amount and an item are never the same
    feed = spark.createDataFrame([("k", "category", "fuel"), ("k", "amount", "5"), ("k", "merchant", ""), (None, "flow", "fee")], "txn_key string, field string, value string")
    assert [Ledger.of(store, RULES).correct_feed(store, feed, "2026-09-01 00:00:00") for _ in range(2)] == [2, 0]


def test_retry_schedule(spark):
    t = datetime(2026, 8, 1)
    tries = [(1, i, t + timedelta(minutes=i), "error") for i in range(7)] + [(2, 1, t, "error"), (2, 2, t, "ok"), (2, 3, t, "error"), (2, 4, t, "error"), (3, 1, t, "ok"), (4, 1, None, "error"), (None, 1, t, "error")]
    df = spark.createDataFrame(tries, "receipt_id long, id long, created_at timestamp, status string")
    got = {r["receipt_id"]: (r["failures"], r["due_at"]) for r in retry_schedule(df, ["receipt_id"]).collect()}
    assert got == {1: (7, t + timedelta(minutes=6, seconds=300)), 2: (2, t + timedelta(seconds=30)), 4: (1, None), None: (1, t + timedelta(seconds=15))}
    assert retry_schedule(df, []).count() == 1 and retry_schedule(df.limit(0), ["receipt_id"]).count() == 0


def test_lines(spark):
    boxes = [("p", 0, 50.0, 10.0, 8.0, "3.49"), ("p", 1, 0.0, 12.0, 8.0, "SOURDOUGH"), ("p", 2, 0.0, 30.0, 20.0, "TOTAL"), ("p", 3, 60.0, 41.9, 6.0, "3.49"), ("p", 4, 0.0, 60.0, 2.0, None), ("q", 0, 0.0, 0.0, 0.0, "a"), ("q", 1, 0.0, 0.0, 0.0, "b"), ("q", 2, 0.0, None, 1.0, "lost")]
    got = cluster_lines(spark.createDataFrame(boxes, "page string, seq int, x double, y double, h double, text string"))
    assert sorted((r["page"], r["line_no"], r["line"]) for r in got.collect()) == [("p", 0, "SOURDOUGH  3.49"), ("p", 1, "TOTAL  3.49"), ("p", 2, ""), ("q", 0, "a  b")]


def test_ranges_agree_with_one_task(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        boxes = spark.range(3000).select(F.lit("hot").alias("page"), F.col("id").alias("seq"), F.col("id").alias("x"), (F.col("id") * 7919 % 3001).cast("double").alias("y"), (1 + F.col("id") % 3).cast("double").alias("h"), F.col("id").cast("string").alias("text"))
        got = {r["line_no"]: r["fragments"] for r in cluster_lines(boxes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ordered, want, line, last = sorted((i * 7919 % 3001, 1 + i % 3) for i in range(3000)), {}, 0, None
    for y, h in ordered:
        if last and y - last[0] > 0.6 * max(h, last[1]):
            line += 1
        want[line] = want.get(line, 0) + 1
        last = (y, h)
    assert got == want


def test_eviction(spark):
    files = [("a", at(1), 10), ("b", at(1), 10), ("c", at(2), 5), ("d", None, 7), ("e", at(3), None), ("f", at(4), 30)]
    df = spark.createDataFrame(files, "path string, at timestamp, bytes long")
    gone = lambda budget: sorted(r["path"] for r in retention.evicted(df, budget).collect())
    assert gone(62) == [] and gone(61) == ["d"] and gone(55) == ["d"] and gone(54) == ["a", "d"] and gone(30) == ["a", "b", "c", "d"] and len(gone(-1)) == 6


def test_reconciliation(spark):
    seen = [("A", at(5, 9), "1", 1000), ("A", at(8, 9), "2", 700), ("A", at(8, 10), "3", 690), ("A", at(9, 9), "4", None), ("B", at(5, 9), "1", 50)]
    moves = [("A", date(2026, 8, 5), -500), ("A", date(2026, 8, 6), -250), ("A", date(2026, 8, 8), -50), ("A", date(2026, 8, 9), -1), ("A", None, 7), ("C", date(2026, 8, 1), 9)]
    out = reconciliation.reconciled(spark.createDataFrame(seen, "account string, at timestamp, uid string, balance_cents long"), spark.createDataFrame(moves, "account string, day date, amount_cents long"))
    got = sorted((r["account"], r["uid"], r["moved_cents"], r["explained_cents"], r["unexplained_cents"]) for r in out.collect())
    assert got == [("A", "1", -500, None, None), ("A", "2", -800, -300, 0), ("A", "3", -800, 0, -10), ("B", "1", 0, None, None)]


def test_a_large_batch_is_grouped_once(spark, tmp_path):
    """Whether a batch is small is asked of its rows as they come; one that is not runs through its grouping only to be stored."""
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("uid"), F.lit("s").alias("source"), F.lit("2026-08-01").cast("timestamp").alias("started_at"))
    store = Store(spark, str(tmp_path / "s"))
    polls_of = lambda n: schemas.shaped(rows(n), schemas.FEED_POLLS)
    assert store.append_new({"feed_polls": polls_of(2000)}, polls.KEYED) == {"feed_polls": 2000}
    assert sum(f.stat().st_size for f in (tmp_path / "s" / "data").rglob("*.parquet")) < 500_000  # filters fit the rows
    seen = spark.sparkContext.accumulator(0)
    counted = polls_of(3000).rdd.map(lambda r: (seen.add(1), r)[1])
    assert store.append_new({"feed_polls": spark.createDataFrame(counted, schemas.FEED_POLLS)}, polls.KEYED) == {"feed_polls": 1000}
    assert seen.value < 3 * 3000
    repeated = polls_of(3).unionAll(polls_of(3)).unionAll(polls_of(3003).filter("uid >= 3000"))
    assert store.append_new({"feed_polls": repeated}, polls.KEYED) == {"feed_polls": 3}


def test_digests_are_made_where_rows_are_stored(spark, tmp_path):
    """A batch without them doesn't move them: a stream's files were shuffled and written at twice their size."""
    store = Store(spark, str(tmp_path / "t"))
    seen = [("s", "a", e, c, "2026-08-01", at) for e, c, at in (("1", "x", datetime(2026, 8, 2)), ("1", "x", datetime(2026, 8, 1)), ("2", "y", None))]
    batch = spark.createDataFrame(seen, "source string, native_account string, external_id string, content_sha256 string, posted_at string, observed_at timestamp").withColumn("transacted_at", F.lit(None).cast("string"))
    assert [store.append_new({"feed_records": batch}, polls.KEYED)["feed_records"] for _ in range(2)] == [2, 0]
    rows = store.table("feed_records").withColumn("want", polls.record_uid()).filter("external_id = '1'").collect()
    assert [(r["uid"] == r["want"], r["observed_at"]) for r in rows] == [(True, datetime(2026, 8, 1))]
    paths = [f["path"] for f in store.version().folders("feed_records")]
    assert any(".zstd." in p.name for path in paths for p in Path(path).rglob("*.parquet"))


def test_lines_of_small_pages_are_shuffled_once(spark):
    """They were written twice and shuffled six times; large pages still go over ranges, with the same lines."""
    boxes = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 9 % 3 * (F.col("id") % 2)).alias("page"), F.col("id").alias("seq"), (F.col("id") * 37 % 101).alias("x"), (F.col("id") * 7919 % 901).cast("double").alias("y"), (1 + F.col("id") % 3).cast("double").alias("h"), F.col("id").cast("string").alias("text"))
    one = cluster_lines(boxes)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = sorted(map(str, one.collect()))
    assert boxes.groupBy("page").count().filter("count > 250").count() in (1, 2)
    assert len(want) > 500 and sorted(map(str, cluster_lines(boxes, most=250).collect())) == want == sorted(map(str, cluster_lines(boxes, most=1).collect()))


def test_digests_are_moved_as_bytes(spark):
    """A record's uid was most of what its one shuffle moved; other texts than digests stay as they are."""
    uids = ["ab" * 32, "00ff", "0FF0", "abc", "", "x", "é", "ab\n", None]
    given = spark.createDataFrame([(u, f"e{i}") for i, u in enumerate(uids)], "uid string, external_id string").withColumns({"source": F.lit("s"), "native_account": F.lit("a"), "content_sha256": F.lit("c")})
    dealt = observations.by_transaction(given)
    assert sorted(((r["external_id"], r["uid"]) for r in dealt.collect())) == [(f"e{i}", u) for i, u in enumerate(uids)]
    assert dealt.columns == [*given.columns, "txn_key", "__content"]
    assert "unhex(uid" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_raw_columns_are_moved_and_sorted_once(spark):
    """Line items moved the digests and descriptions made of them, and were sorted again for the newest observation."""
    dealt = adapter.records(spark, "/root/testdata/sf0.001", dealt=True)
    newest = observations.collapsed(observations.deduplicated(dealt)).drop("poll_uid")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Sort [") == 1
    moved = newest._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "to_json" not in moved and "upper(p_name" not in moved
    plain = observations.collapsed(observations.deduplicated(adapter.records(spark, "/root/testdata/sf0.001"))).select(*newest.columns)
    assert sorted(map(str, newest.collect())) == sorted(map(str, plain.collect()))


def test_one_of_tied_observations_is_the_newest(spark):
    tied = spark.createDataFrame([("u", c, a) for c, a in (("c", 1), ("d", 2), ("c", 1))], "uid string, content_sha256 string, amount_cents long").withColumns({"source": F.lit("s"), "native_account": F.lit("a"), "external_id": F.lit("e"), "observed_at": F.lit(None).cast("timestamp")})
    for rows, revisions in ((tied, 3), (observations.deduplicated(tied), 2)):
        assert [(r["revisions"], r["amount_changed"]) for r in observations.collapsed(rows).collect()] == [(revisions, True)]


def test_contents_are_told_where_rows_are_stored(spark, tmp_path):
    """Digests of contents were moved as text, and stored keys shuffled beside the batch's for a join; filters took 64 KiB a file."""
    store = Store(spark, str(tmp_path / "t"))
    seen = [("s", "a", e, d, "2026-08-01", at) for e, d, at in (("1", "x", datetime(2026, 8, 2)), ("1", "x", datetime(2026, 8, 1)), ("1", "y", datetime(2026, 8, 1)), ("2", None, None))]
    batch = spark.createDataFrame(seen, "source string, native_account string, external_id string, description string, posted_at string, observed_at timestamp").withColumns({c: F.lit(None).cast("string") for c in ("transacted_at", "payee", "memo")} | {"amount_cents": F.lit(5), "pending": F.lit(False)})
    assert store.append_new({"feed_records": batch}, polls.KEYED)["feed_records"] == 3
    more = batch.unionByName(batch.filter("external_id = '2'").withColumn("amount_cents", F.lit(6)))
    assert [store.append_new({"feed_records": more}, polls.KEYED)["feed_records"] for _ in range(2)] == [1, 0]
    given = batch.withColumn("content_sha256", content_hash())
    assert store.append_new({"feed_records": given}, polls.KEYED)["feed_records"] == 0
    rows = store.table("feed_records").withColumn("want", polls.record_uid()).collect()
    assert len(rows) == 4 and all(r["uid"] == r["want"] and len(r["content_sha256"]) == 64 for r in rows)
    new = store._new("feed_records", more, polls.KEYED["feed_records"], store.version())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "to_json" not in new._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert max(f.stat().st_size for f in (tmp_path / "t" / "data").rglob("*.parquet")) < 20_000


def test_a_stream_file_is_written_without_a_shuffle(spark):
    """Observations were moved to four tasks to be written; four folders need no shuffle."""
    rows = spark.range(100).withColumn("uid", F.sha2(F.col("id").cast("string"), 256)).repartition(3)
    path, half = _delivered(rows, F.crc32("uid"))
    back = spark.read.parquet(path)
    assert half == 6 and sorted(r["delivery"] for r in back.select("delivery").distinct().collect()) == [0, 1, 2, 3]
    assert sorted(r["id"] for r in back.collect()) == list(range(100))

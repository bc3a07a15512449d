"""A folder of exports in any mixture: every file has an outcome and nothing is raised."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import importer, spoken, statements

CREDIT = "Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit\n2026-08-14,2026-08-15,4471,KEY FOOD,x,5.00,\n2026-08-14,2026-08-15,4471,REFUND,x,,2.00\n,,,,,,\n"
CHECKING = "Account Number,Transaction Date,Transaction Amount,Transaction Type,Transaction Description,Balance\r\n123456789,08/14/26,1200.00,Credit,PAYROLL,5\r\n123456789,08/15/26,n/a,Debit,RENT,5\r\n"
CARD = '"Merchant","Amount (USD)","Type","Clearing Date","Transaction Date","Description"\n"Cafe, Inc","4.75","Purchase","08/15/2026","08/14/2026","CAFE ""A"""\n"","50.00","Payment","08/16/2026","08/16/2026","ACH, DEPOSIT"\n'
QUOTED = 'Transaction Date,Posted Date,Card No.,Description,Category,Debit,Credit\n2026-08-01,2026-08-02,4471,"TWO\nLINES",x,1.00,\n2026-08-01,2026-08-02,4471,PLAIN,x,2.00,\n'
OFX = "OFXHEADER:100\n<OFX><ACCTID>000123456\n<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260814120000[-5:EST]\n<TRNAMT>-12.34<FITID>f1<NAME>SHOP</STMTTRN>\n<STMTTRN><DTPOSTED>20260815<TRNAMT>oops<NAME>BAD</STMTTRN>\n"
MIXED = {"credit.csv": "﻿" + CREDIT, "checking 1.txt": CHECKING, "card[x].csv": CARD, "quoted.csv": QUOTED, "bank.ofx": OFX, "unknown.csv": "Date,Amount\n2026-01-01,5\n", "empty.csv": "", "blank.csv": "\n2026-08-14,5\n", "header.csv": CREDIT.splitlines()[0], "twice.csv": "Debit," + CREDIT.splitlines()[0] + "\n9.99,2026-08-14,2026-08-15,1234,TWICE,x,3.00,,extra\n2026-08-14\n", "notes.md": "not an export"}


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    for name, text in MIXED.items():
        (root / name).write_bytes(text.encode())
    return root


def test_every_file_has_an_outcome(spark, inbox):
    got = importer.import_folder(spark, str(inbox))
    files = {os.path.basename(r["file"]).replace("%20", " ").replace("%5B", "[").replace("%5D", "]"): r for r in got.files.collect()}
    told = {n: (r["outcome"], r["dialect"], r["rows"], r["bad"], r["synthesised"]) for n, r in files.items()}
    assert told == {
        "credit.csv": ("ok", "capitalone-credit", 2, 0, 2), "checking 1.txt": ("partial", "capitalone-checking", 2, 1, 2), "card[x].csv": ("ok", "applecard", 2, 0, 2), "quoted.csv": ("ok", "capitalone-credit", 2, 0, 2), "bank.ofx": ("partial", "ofx", 2, 1, 1),
        "unknown.csv": ("error", None, 0, 0, 0), "empty.csv": ("error", None, 0, 0, 0), "blank.csv": ("error", None, 0, 0, 0), "header.csv": ("ok", "capitalone-credit", 0, 0, 0), "twice.csv": ("partial", "capitalone-credit", 2, 1, 2),
    }
    notes = {os.path.basename(r["file"]): (r["code"], r["note"]) for r in got.rejected.collect()}
    assert notes == {"unknown.csv": (importer.UNKNOWN, "no dialect claims these columns: Amount, Date"), "empty.csv": (importer.UNKNOWN, "the file has no header row"), "blank.csv": (importer.UNKNOWN, "the file has no header row")}


def test_rows(spark, inbox):
    rows = {r["description"]: r for r in importer.import_folder(spark, str(inbox)).rows.collect()}
    assert (rows["KEY FOOD"]["amount_cents"], rows["REFUND"]["amount_cents"], rows["REFUND"]["line"]) == (-500, 200, 2)
    assert (rows["PAYROLL"]["amount_cents"], rows["PAYROLL"]["posted_at"], rows["RENT"]["reject_reason"]) == (120000, "2026-08-14", "no digits in 'n/a'")
    assert (rows['CAFE "A"']["amount_cents"], rows['CAFE "A"']["payee"], rows["ACH, DEPOSIT"]["flow_hint"], rows["ACH, DEPOSIT"]["amount_cents"]) == (-475, "Cafe, Inc", "payment", 5000)
    assert (rows["TWO\nLINES"]["amount_cents"], rows["PLAIN"]["amount_cents"]) == (-100, -200)
    assert (rows["SHOP"]["external_id"], rows["SHOP"]["amount_cents"]) == ("f1", -1234)
    assert (rows["TWICE"]["amount_cents"], rows["TWICE"]["native_account"]) == (-300, "drop:capitalone-credit:1234")  # the later of two columns of a name


def test_same_as_one_file_alone(spark, inbox, tmp_path):
    (tmp_path / "a.csv").write_bytes(MIXED["card[x].csv"].encode())
    alone = statements.read_csv(spark, str(tmp_path / "a.csv"))
    both = importer.import_folder(spark, str(inbox)).rows.filter("dialect = 'applecard'")
    columns = [c for c in statements.FIELDS if c != "external_id"]
    assert sorted(map(tuple, alone.select(columns).collect())) == sorted(map(tuple, both.select(columns).collect()))


def test_one_file_in_many_splits(spark, tmp_path):
    n = 3000
    body = "".join(f"2026-08-{1 + i % 28:02d},2026-08-{1 + i % 28:02d},4471,SHOP {i // 2},x,{i // 2}.00,\n" for i in range(n))
    (tmp_path / "large.csv").write_text(CREDIT.splitlines()[0] + "\n" + body)
    (tmp_path / "small.csv").write_text(CREDIT)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = importer.import_folder(spark, str(tmp_path))
        rows = got.rows.filter("file like '%large%'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["line"] for r in rows) == list(range(1, n + 1)) and all(r["description"] == f"SHOP {(r['line'] - 1) // 2}" for r in rows)
    assert len({r["external_id"] for r in rows}) == n


def test_blocks_do_not_carry_their_file(spark):
    """A row a block, each with the whole text beside it, takes the square of a file's length."""
    plan = statements.parse_ofx(spark.createDataFrame([("a", OFX)], "file string, value string"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate ")]
    assert "value#" not in above
    beneath = plan[plan.index("Generate ") :].split("\n")
    assert "value#" not in beneath[0] and "Project" in beneath[1] and "native_account" in beneath[1]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "notes.md").write_text("x")
    (tmp_path / "empty.csv").write_text("")
    got = importer.import_folder(spark, str(tmp_path))
    assert got.rows.count() == 0 and [r["outcome"] for r in got.files.collect()] == ["error"]


def test_text_receipts(spark):
    said = spark.createDataFrame([(1, datetime(2026, 8, 14, 9, 5, 59), "  coffee 4.75 at Cafe \n"), (2, datetime(2026, 8, 14), " \t\n"), (3, datetime(2026, 8, 14), None), (4, None, "x"), (5, datetime(2026, 8, 14, 9, 5, 1), "coffee 4.75 at Cafe")], "id int, said_at timestamp, text string")
    told, refused = spoken.text_receipts(said)
    rows = {r["id"]: r for r in told.collect()}
    assert rows[1]["body"] == "Date: 2026-08-14\nTime: 09:05\n\ncoffee 4.75 at Cafe\n" and rows[1]["sha256"] == rows[5]["sha256"]
    assert {r["id"]: r["reason"] for r in refused.collect()} == {2: "nothing was said", 3: "nothing was said", 4: "no time"}
    assert told.filter(F.col("text").isNull()).count() == 0


def test_lines_are_parsed_once_by_their_headers_width(spark, tmp_path):
    """Each line was parsed twice into 64 columns, with an exception inside for those that it lacks; a code too large to be compiled is none."""
    head = "Transaction Date,Clearing Date,Description,Merchant,Category,Type,Amount (USD)"
    lines = [head, '08/01/2026,08/02/2026,"A, ""B""",Shop,x,Purchase,$5.00', "", ",,,,,,", " ,,,,,,,,late", '"",,,', "08/03/2026,08/04/2026,short", "08/05/2026,08/06/2026,C,Shop,x,Payment,7.00,beyond"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("Transaction Date,Posted Date,Description,Debit,Credit,Debit\n2026-08-01,2026-08-02,D,1.00,,2.00\n")
    got = importer.import_folder(spark, str(tmp_path))
    rows = sorted((r["dialect"], r["line"], r["posted_at"], r["description"], r["amount_cents"], r["flow_hint"]) for r in got.rows.collect())
    assert rows == [("applecard", 1, "2026-08-02", 'A, "B"', -500, None), ("applecard", 4, None, "", None, None), ("applecard", 6, "2026-08-04", "short", None, None), ("applecard", 7, "2026-08-06", "C", 700, "payment"), ("capitalone-credit", 1, "2026-08-02", "D", -200, None)]
    lines = spark.createDataFrame([("f", 1, "applecard", head.split(","), lines[1])], "file string, line long, dialect string, names array<string>, value string")
    placed = lines.withColumn("at", F.struct(*[importer._place(c).alias(c) for c in importer._READ]))
    plan = importer._by_dialect(importer._split(placed, [7]))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and plan.count("from_csv(") == 2  # by its width, and beyond if it is blank so far

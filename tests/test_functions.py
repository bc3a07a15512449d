"""Scalar functions against tables of expected values, and money against an independent decimal parser."""

from __future__ import annotations

import re
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import dates, ids, money, payload, text
from ledgerline.plans import catalogue


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", fn(F.col("v")).alias("o"))
    return [r["o"] for r in sorted(df.collect(), key=lambda r: r["i"])]


MONEY = {
    "33.03": 3303, "$1,234.50": 123450, "1,234": 123400, "0.745": 75, "(5.00)": -500, "5.00-": -500, "-5": -500, "": None, "   ": None, None: None, "1.234,56": 123456, ",50": 50, "1,234,567": 123457, "$(5.00)": 500, "THIRTY 3": 300,
}


def test_to_cents(spark):
    got = apply(spark, list(MONEY), money.to_cents)
    assert [r["cents"] for r in got] == list(MONEY.values())
    assert all(r["reject_reason"] is None for r in got)


def test_to_cents_tells_why_not(spark):
    got = apply(spark, ["THIRTY THREE", "12.", "1-2"], money.to_cents)
    assert [(r["cents"], r["reject_reason"]) for r in got] == [(None, "no digits in 'THIRTY THREE'"), (None, "not an amount: '12.'"), (None, "not an amount: '1-2'")]


def test_to_cents_rounds_half_up(spark):
    values = [f"{n // 1000}.{n % 1000:03d}" for n in range(0, 3000, 7)]
    assert [r["cents"] for r in apply(spark, values, money.to_cents)] == [int((Decimal(v) * 100).quantize(Decimal(1), ROUND_HALF_UP)) for v in values]


def test_formats(spark):
    assert apply(spark, [123456, -5, None], money.format_cents, "bigint") == ["$1,234.56", "-$0.05", "—"]
    assert apply(spark, [123456, -5, None], money.amount_string, "bigint") == ["1234.56", "-0.05", None]


MERCHANTS = {
    "SQ *BLUE BOTTLE COFFEE": "Blue Bottle Coffee", "POS DEBIT 09/12 KEY FOOD #1234": "Key Food", "TST* JOE'S PIZZA": "Joe's Pizza", "7-ELEVEN 36412": "7-Eleven", "CVS": "CVS", "BANK OF THE WEST": "Bank of the West", "JOES PIZZA BROOKLYN NY": "Joes", "12345": None, "": None, None: None, "####": None, "NETFLIX RT4G91OJ3": "Netflix",
}


def test_merchant_names(spark):
    assert apply(spark, list(MERCHANTS), text.merchant_name) == list(MERCHANTS.values())


def test_merchant_keys(spark):
    assert apply(spark, ["Trader Joe's", "TRADER  JOES", "...", None, "Café 21"], text.merchant_key) == ["trader joes", "trader joes", None, None, "café 21"]


def test_merchant_keys_of_all_documents(spark, tmp_path):
    made = ["Straße ẞ ΟΔΟΣ ς", "I\u0307stanbul İ", "Cafe\u0301 №5 x² ½ ‿ 日本 🙂 ﬁn", "a_b — «c»", "🙂ß🙂", "Ꭰꭰ", "...", "", None]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        want = {r["doc_id"]: r["text"] and (" ".join(re.sub(r"[^\w\s]", "", r["text"].casefold()).split()) or None) or None for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        assert {r["doc_id"]: r["key"] for r in catalogue.QUERIES["f11_merchant_key"](spark, folder).collect()} == want


def test_other_text(spark):
    assert apply(spark, ["Card 1234-5678", "12", None], lambda c: text.last_four(c, "acct")) == ["5678", "12", "acct"]
    assert apply(spark, ["Blue  Card (1)"], text.slug) == ["blue-card-1"]
    assert apply(spark, ["1", "yes", "no", None], text.truthy) == [True, True, False, False]


DATES = {
    "2026-08-14": date(2026, 8, 14), "8/4/2026": date(2026, 8, 4), "08/14/26": date(2026, 8, 14), "1/2/70": date(1970, 1, 2), "25/12/2025": date(2025, 12, 25), "2026/1/2": date(2026, 1, 2), "08-14-2026": date(2026, 8, 14), "20260814120000[-5:EST]": date(2026, 8, 14), "2026-02-30": None, "soon": None, "": None, None: None,
}


def test_parse_date(spark):
    assert apply(spark, list(DATES), dates.parse_date) == list(DATES.values())


def test_local_date(spark):
    assert apply(spark, ["2026-09-01T01:30:00Z", "2026-09-01", "2026-09-01T12:00:00+00:00", "x", None], lambda c: dates.local_date(c, "America/New_York")) == [date(2026, 8, 31), date(2026, 9, 1), date(2026, 9, 1), None, None]


def test_identity(spark):
    import hashlib

    df = spark.range(1).select(ids.txn_key(F.lit("drop"), F.lit("a"), F.lit("1")).alias("k"))
    assert df.first()["k"] == hashlib.sha256("drop\x1fa\x1f1".encode()).hexdigest()[:24]
    rows = [("a", "2026-01-01", 475, "coffee", i) for i in range(2)] + [("a", None, None, "x", 2)]
    made = [r["id"] for r in spark.createDataFrame(rows, "native_account string, posted_at string, amount_cents bigint, description string, n int").select(ids.synthesised_id(F.col("n")).alias("id")).collect()]
    assert len(set(made)) == 3
    assert hashlib.sha256("a\x1f2026-01-01\x1f475\x1fcoffee\x1f1".encode()).hexdigest()[:24] in made
    assert hashlib.sha256("a\x1f\x1fNone\x1fx\x1f0".encode()).hexdigest()[:24] in made


def test_payload(spark):
    got = apply(spark, ['{"merchant":"A","purchased_on":"unknown","currency":"usdx","category":"Fuel","line_items":[]}', '{"purchased_on":"2026-01-02","category":"toys"}'], payload.receipt)
    assert (got[0]["purchased_on"], got[0]["currency"], got[0]["category"]) == (None, "USD", "fuel")
    assert (got[1]["purchased_on"], got[1]["currency"], got[1]["category"], got[1]["line_items"]) == (date(2026, 1, 2), "USD", None, [])


@pytest.mark.parametrize("errors,wanted", [('[{"code":"con.auth"}]', True), ('[{"code":"act.failed"}]', False), ("[]", False), (None, False)])
def test_error_codes(spark, errors, wanted):
    assert apply(spark, [errors], payload.needs_a_human) == [wanted]


def test_folding_scans_few_ranges(spark):
    """Every mark is folded as Python does, in long texts too, and looked for by ranges instead of one by one."""
    every = "".join(text.FOLDED)
    rows = [(c,) for c in every] + [("Straße " * 3000 + every,), ("plain " * 3000,)]
    df = spark.createDataFrame(rows, "t string").select("t", text.folded(F.col("t")).alias("folded"))
    assert all(r["folded"] == r["t"].lower().casefold() for r in df.collect())
    assert "".join(text.FOLDED)[:20] not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(text._ranges(list(text.FOLDED))) < 10 * len(text.FOLDED)


def test_passes_that_change_nothing_are_the_last(spark):
    want = {"SQ *KEY FOOD 0012 BROOKLYN NY": "Key Food", "SHOP, - #12  #34 #56": "Shop", "SHOP #1 #2 #3 #4": "Shop #1", "TST* #12": "#12", "A  B  C": "A B C"}
    df = spark.createDataFrame([(d,) for d in want], "d string").select("d", text.stripped(F.col("d")).alias("s"))
    assert {r["d"]: r["s"].upper() for r in df.collect()}["SHOP #1 #2 #3 #4"] == "SHOP #1"
    assert {r["s"].upper() for r in df.collect()} >= {"SHOP", "A B C"}


def test_no_pass_is_begun_where_no_trailer_can_be(spark):
    """Each pass looked for eight trailers, the last one in vain; one look tells."""
    ends = ["#12", " 555-123-4567", "XX12", "a1b2c3d4", "NEW YORK NY", " US", "USA ", "09/12", "-", ", 12", "", " usa", " x9", "#4 ", "a5bcdef gh"]
    texts = [f"{head} {a} {b}" for head in ("BLUE RING", "", "X") for a in ends for b in ends]

    def plain(kept, passes=text.PASSES):
        shorter = kept
        for pattern in text.TRAILERS:
            shorter = text._edges(F.regexp_replace(shorter, pattern, ""))
        return text.let(shorter, lambda x: F.when((x == "") | (x == kept), kept).otherwise(plain(x, passes - 1) if passes > 1 else x))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r for r in df.select("t", text.without_trailers(F.col("t")).alias("got"), text.let(F.col("t"), lambda w: plain(w)).alias("want")).collect() if r["got"] != r["want"]] == []
    assert "RLIKE" in df.select(text.without_trailers(F.col("t")))._jdf.queryExecution().analyzed().toString()

"""Amounts as whole cents. Absent is null, never zero; unreadable text has a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import let, trimmed

#: Currency symbols for display.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£"}


def to_cents(text: Column) -> Column:
    """struct(cents, reject_reason) of an amount as receipts and statements write it.

    Whole parentheses or a minus at either end negate. The last separator is the decimal mark, unless the
    only one is a comma before exactly three digits. Halves of a cent round away from zero.
    """
    raw = trimmed(text)
    kept = F.regexp_replace(F.regexp_replace(raw, r"(?s)^\((.*)\)$", "$1"), r"[^0-9.,\-()]", "")
    parts = F.struct(text.alias("text"), raw.alias("raw"), kept.alias("kept"), F.regexp_replace(F.regexp_replace(kept, "^-|-$", ""), "[()]", "").alias("bare"))

    def read(p: Column) -> Column:
        bare = p["bare"]
        last = r"^(.*)[.,]([^.,]*)$"
        number = (
            F.when(~bare.rlike("[.,]"), F.concat(bare, F.lit(".00")))
            .when(bare.rlike(r"^[^.,]*,[^.,]{3}$"), F.concat(F.regexp_replace(bare, ",", ""), F.lit(".00")))
            .otherwise(F.concat(F.regexp_replace(F.regexp_extract(bare, last, 1), "[.,]", ""), F.lit("."), F.regexp_extract(bare, last, 2)))
        )
        digits = F.when((bare != "") & number.rlike(r"^[0-9]*\.[0-9]+$"), F.concat(F.lit("0"), number))
        cents = F.round(digits.try_cast("decimal(38,12)") * 100, 0).try_cast("bigint")
        negative = p["raw"].rlike(r"(?s)^\(.*\)$") | p["kept"].rlike("^-|-$")
        return F.struct(F.when(negative, -cents).otherwise(cents).alias("cents"), bare.alias("bare"), p["raw"].alias("raw"), p["text"].alias("text"))

    def told(p: Column) -> Column:
        unread = p["cents"].isNull() & p["text"].isNotNull() & (p["raw"] != "")
        reason = F.when(unread, F.concat(F.when(p["bare"] == "", "no digits in '").otherwise("not an amount: '"), p["text"], F.lit("'")))
        return F.struct(p["cents"].alias("cents"), reason.alias("reject_reason"))

    return let(let(parts, read), told)


def cents_or_null(text: Column) -> Column:
    """to_cents() where unreadable is as good as absent."""
    return to_cents(text)["cents"]


def format_cents(cents: Column, currency: Column | None = None) -> Column:
    """For display: sign, symbol, thousands. A dash if absent."""
    currency = F.lit("USD") if currency is None else currency
    symbol = F.lit("")
    for code, mark in SYMBOLS.items():
        symbol = F.when(currency == code, F.lit(mark)).otherwise(symbol)
    size = F.abs(cents)
    shown = F.concat(F.when(cents < 0, "-").otherwise(""), symbol, F.format_number(F.floor(size / 100), 0), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    return F.when(cents.isNull(), F.lit("—")).otherwise(shown)


def amount_string(cents: Column) -> Column:
    """A plain decimal string, for display only."""
    size = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(size / 100).cast("string"), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def outflow(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.greatest(-amount, F.lit(0)))


def inflow(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.greatest(amount, F.lit(0)))

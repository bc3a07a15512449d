"""Calendar dates out of text, and instants to local dates. The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import let, trimmed


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")).cast("date")


def parse_date(text: Column) -> Column:
    """A bare date in any of the forms that statements use, tried in order; last, eight leading digits."""

    def read(raw: Column) -> Column:
        def form(pattern: str, y: int, m: int, d: int, short: bool = False) -> Column:
            part = lambda k: F.regexp_extract(raw, pattern, k)
            year = part(y)
            if short:  # two digits: 69 and later are the last century
                year = F.concat(F.when(part(y) >= "69", "19").otherwise("20"), part(y))
            return F.when(raw.rlike(pattern), _ymd(year, part(m), part(d)))

        return F.coalesce(
            form(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
            form(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
            form(r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3, 1, 2, short=True),
            form(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
            form(r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3),
            form(r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 1, 2),
            form(r"^(\d{4})(\d{2})(\d{2})", 1, 2, 3),
        )

    return let(trimmed(text), read)


def iso_date(text: Column) -> Column:
    """A strict year-month-day, or null."""
    raw = trimmed(text)
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")).cast("date"))


def local_date(instant: Column, tz: str) -> Column:
    """The calendar date in tz of an instant in text; a bare date passes through unshifted."""
    return F.when(F.length(instant) == 10, iso_date(instant)).otherwise(F.to_date(F.from_utc_timestamp(instant.try_cast("timestamp"), tz)))


def unix_instant(seconds: Column) -> Column:
    """An instant of Unix seconds; zero and null mean there is none yet."""
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_label(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMMM yyyy"), F.lit("No date"))

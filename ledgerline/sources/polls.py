"""Recording what a poll saw: its outcome, its accounts and its records become visible together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.ids import content_hash
from ledgerline.operators.observations import KEYS
from ledgerline.schemas import FEED_ACCOUNTS, FEED_POLLS, FEED_RECORDS, shaped
from ledgerline.sources.snapshots import Keyed, Store, month_of

RECORD_KEYS = (*KEYS, "content_sha256")


def record_uid() -> Column:
    """A record's digest over RECORD_KEYS."""
    return F.sha2(F.concat_ws("\x1f", *RECORD_KEYS), 256)


#: An observation's month is that of the day it was posted or made, which its content holds: seen again, it is looked for where it is.
KEYED = {
    "feed_polls": Keyed(("uid",), "uid", ("started_at",), month_of("cast(started_at AS string)")),
    "feed_accounts": Keyed(("uid",), "uid", ("observed_at",), month_of("cast(balance_at AS string)")),
    "feed_records": Keyed(RECORD_KEYS, "uid", ("observed_at", "uid"), month_of("coalesce(posted_at, transacted_at)"), {"content_sha256": content_hash, "uid": record_uid}, KEYS),
}
SCHEMAS = {"feed_polls": FEED_POLLS, "feed_accounts": FEED_ACCOUNTS, "feed_records": FEED_RECORDS}


def record_poll(store: Store, polls: DataFrame, accounts: DataFrame, records: DataFrame) -> dict[str, int]:
    """Append polls with all they saw, in one commit; returns how many rows of each were new.

    Polls without records count too: they tell silence from failure. What was seen before is not stored again, and
    recording the same poll twice adds nothing, so a poll whose recording was cut off is simply recorded anew. Only one of
    repeated rows stays, the one seen first; columns that the tables don't have are left out. Records without a digest of their
    content get it where they are stored.
    """
    given = {"feed_polls": polls, "feed_accounts": accounts, "feed_records": records}
    shapes = {n: shaped(df, SCHEMAS[n]) for n, df in given.items()}
    made = [c for c in KEYED["feed_records"].made if c == "uid" or c not in records.columns]  # where they are stored
    return store.append_new(shapes | {"feed_records": shapes["feed_records"].drop(*made)}, KEYED)


def new_by_poll(records: DataFrame) -> DataFrame:
    """(poll_uid, n): how many records each poll was the first to see."""
    return records.groupBy("poll_uid").agg(F.count(F.lit(1)).alias("n"))

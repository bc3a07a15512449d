"""Latest observation, exact dedup, and last edit of each field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgerline.functions.ids import txn_key


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order: one shuffle, partial minima before it.

    Of rows that tie, the least by its other columns. What orders is moved and kept once, not beside the row again.
    """
    first = [c for c in order if c not in keys]  # keys are alike within a group
    rest = [c for c in df.columns if c not in keys and c not in first]
    if not (first or rest):
        return df.select(*keys).distinct().select(*df.columns)
    held = F.struct(*first, *rest)
    first = F.min(held) if all(_orderable(df.schema[c].dataType) for c in rest) else F.min_by(held, F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def _orderable(kind: DataType) -> bool:
    """Whether rows may be compared by such a column."""
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


def latest_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


KEYS = ("source", "native_account", "external_id")


def content_digest() -> Column:
    """What tells a record's content from another of its transaction: bytes, in a quarter of content_sha256's room."""
    return F.unhex(F.md5("content_sha256"))


def by_transaction(records: DataFrame) -> DataFrame:
    """records with txn_key and a digest of their content, all of a transaction in one partition.

    That is the one shuffle of deduplicated(), collapsed() and a join of edits by txn_key, and takes the columns that are
    read after it. A transaction is observed a few times, so nothing is summed up before it. Who makes records of narrower
    rows moves those instead, by the same key, and hands over records that have txn_key already.
    """
    content = content_digest()
    if "txn_key" in records.columns:
        return records if "__content" in records.columns else records.withColumn("__content", content)
    digest = F.unhex("uid")  # moved as bytes, in half the room, where it is the same text again
    packed = F.when(F.lower(F.hex(digest)) == F.col("uid"), digest)
    plain = F.when(packed.isNull(), F.col("uid"))
    rows = records.withColumns({"txn_key": txn_key(*[F.col(k) for k in KEYS]), "__content": content, "__uid": packed, "uid": plain})
    return rows.repartition("txn_key").withColumn("uid", F.coalesce("uid", F.lower(F.hex("__uid")))).drop("__uid")


def deduplicated(records: DataFrame) -> DataFrame:
    """Records observed again unchanged count once, at their first observation; with what by_transaction() adds."""
    first = Window.partitionBy("txn_key", *KEYS, "__content").orderBy("observed_at", "uid")
    return by_transaction(records).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def collapsed(records: DataFrame) -> DataFrame:
    """One row a transaction: the newest observation's fields, first_seen_at, last_seen_at, revisions, amount_changed.

    Over windows, so that a column that nobody reads is neither computed nor moved. They are in deduplicated()'s order, so
    both are one sort; the newest observation is looked for in it, the first by content of those that tie.
    """
    rest = [c for c in records.columns if c not in (*KEYS, "txn_key", "__content")]
    own = Window.partitionBy("txn_key", *KEYS).orderBy("__content", "observed_at", "uid")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by_transaction(records).withColumn("__at", F.row_number().over(own)).withColumns({
        "__newest": F.max_by("__at", F.struct("observed_at", "uid", -F.col("__at"))).over(every),
        "first_seen_at": F.min("observed_at").over(every),
        "last_seen_at": F.max("observed_at").over(every),
        "revisions": F.count(F.lit(1)).over(every),
        "amount_changed": F.coalesce(F.min("amount_cents").over(every) < F.max("amount_cents").over(every), F.lit(False)),
    })
    return rows.filter("__at = __newest").select(*KEYS, *rest, "first_seen_at", "last_seen_at", "revisions", "amount_changed", "txn_key")


def last_edits(corrections: DataFrame, key: str, fields: tuple[str, ...], order: list[str]) -> DataFrame:
    """One row a key with, for each field, a struct of its last value: null if never edited, a null value if cleared."""
    known = corrections.filter(F.col("field").isin(*fields))
    last = [F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.struct(*order))).alias(f"edit_{f}") for f in fields]
    return known.groupBy(key).agg(*last)


def edited(field: str) -> Column:
    return F.col(f"edit_{field}").isNotNull()


def edit(field: str) -> Column:
    """The last value, with an empty text as none."""
    return F.nullif(F.col(f"edit_{field}")["value"], F.lit(""))


def vanished(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Transactions of seen accounts that their newest poll no longer listed. seen: (source, native_account, external_id)."""
    accounts = seen.select("source", "native_account").distinct()
    return current.join(accounts, ["source", "native_account"], "left_semi").join(seen, ["source", "native_account", "external_id"], "left_anti")


def listed_ids(records: DataFrame) -> DataFrame:
    """(poll_uid, native_account, ids): how many different ids each poll listed of each account."""
    ids = records.select("poll_uid", "native_account", "external_id").distinct()
    return ids.groupBy("poll_uid", "native_account").agg(F.count("external_id").alias("ids"))


def seen_ids(records: DataFrame) -> DataFrame:
    """(poll_uid, seen): a map of each account's listed ids, an array in one row: for polls of bounded size."""
    by_account = records.groupBy("poll_uid", "native_account").agg(F.sort_array(F.collect_set("external_id")).alias("ids"))
    return by_account.groupBy("poll_uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("native_account", "ids")))).alias("seen"))

"""Balances against transactions: how much of a balance's change its transactions explain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.ordered import RANGE, in_ranges, with_previous, with_sums
from ledgerline.storage import once


def reconciled(observations: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row a balance observation: (account, at, uid, balance_cents, moved_cents, previous_balance_cents, explained_cents, unexplained_cents).

    observations: (account, at, uid, balance_cents); transactions: (account, day, amount_cents). An observation has seen
    the transactions of its day and of all before it. moved_cents: the sum of amounts up to then; explained_cents: its
    change since the account's previous observation; unexplained_cents: the balance's change less that, null for the first.
    Observations without a balance or time and transactions without a day or amount are left out. Observations of one time
    come by uid. An account's transactions are summed to days first, and neither an account nor a day is one task.
    """
    days = transactions.filter("day is not null and amount_cents is not null").groupBy("account", "day").agg(F.sum("amount_cents").alias("amount_cents"))
    null = lambda kind: F.lit(None).cast(kind)
    moves = days.select("account", F.to_date("day").alias("day"), F.lit(0).alias("kind"), null("timestamp").alias("at"), null("string").alias("uid"), "amount_cents", null("bigint").alias("balance_cents"))
    seen = observations.filter("balance_cents is not null and at is not null").select("account", F.to_date("at").alias("day"), F.lit(1).alias("kind"), F.col("at").cast("timestamp").alias("at"), F.col("uid").cast("string").alias("uid"), null("bigint").alias("amount_cents"), "balance_cents")
    order = ["day", "kind", "at", "uid"]
    summed = with_sums(in_ranges(moves.unionByName(seen), ["account"], order), ["account"], order, {"moved_cents": F.col("amount_cents")})
    rows = once(summed.filter("kind = 1"), "observed-balances")
    out = with_previous(rows, ["account"], order, {"previous_balance_cents": F.col("balance_cents"), "__moved": F.col("moved_cents")})
    explained = F.col("moved_cents") - F.col("__moved")
    return out.withColumn("explained_cents", explained).select("account", "at", "uid", "balance_cents", "moved_cents", "previous_balance_cents", "explained_cents", (F.col("balance_cents") - F.col("previous_balance_cents") - explained).alias("unexplained_cents")).drop(RANGE)

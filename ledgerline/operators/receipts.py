"""Receipt extractions and corrections into transactions and line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import iso_date
from ledgerline.functions.money import cents_or_null
from ledgerline.functions.payload import receipt
from ledgerline.functions.text import merchant_key, truthy
from ledgerline.operators.observations import edit, edited, last_edits
from ledgerline.rules import Rules
from ledgerline.schemas import RECEIPT_FIELDS

TOLERANCE_CENTS = 2
#: Seconds until a failed attempt is repeated, at first and at most.
RETRY_SECONDS, RETRY_MOST_SECONDS = 15, 300
ITEM = r"^item\.(\d+)\.(description|qty|unit_price|total)$"


def chosen_extractions(extractions: DataFrame) -> DataFrame:
    """One row a receipt with attempts: the newest usable payload, and what to say if there is none."""
    order = F.struct("created_at", "id")
    usable = (F.col("status") == "ok") & (F.coalesce("payload", F.lit("")) != "")
    return extractions.groupBy("receipt_id").agg(
        F.max_by(F.when(usable, F.struct(F.col("id").alias("extraction_id"), "payload")), F.when(usable, order)).alias("best"),
        F.bool_and(F.col("status") != "ok").alias("all_failed"),
        F.max_by("note", order).alias("last_note"),
    )


def project_items(bases: DataFrame, corrections: DataFrame) -> DataFrame:
    """(receipt_id, line_no, description, qty, unit_cents, total_cents): payload items, patched, blank ones dropped, renumbered.

    Patches address a line by its number in the payload; lines past its end come into being. The last patch of
    an attribute of a line wins, so order between lines doesn't matter. Numbers have up to 18 digits.
    """
    own = bases.select("receipt_id", F.posexplode("p.line_items").alias("at", "item")).select("receipt_id", (F.col("at") + 1).cast("bigint").alias("n"), "item.description", "item.qty", cents_or_null(F.col("item.unit_price")).alias("unit_cents"), cents_or_null(F.col("item.total")).alias("total_cents"))
    patches = corrections.filter(F.col("field").rlike(ITEM)).select("receipt_id", F.regexp_extract("field", ITEM, 1).try_cast("bigint").alias("n"), F.regexp_extract("field", ITEM, 2).alias("field"), "value", "created_at", "id").filter("n >= 1")
    attributes = ("description", "qty", "unit_price", "total")
    last = [F.max_by(F.when(F.col("field") == a, F.struct("value")), F.when(F.col("field") == a, F.struct("created_at", "id"))).alias(f"edit_{a}") for a in attributes]
    patched = own.join(patches.groupBy("receipt_id", "n").agg(*last), ["receipt_id", "n"], "full").select(
        "receipt_id", "n",
        F.when(edited("description"), F.coalesce(edit("description"), F.lit(""))).otherwise(F.col("description")).alias("description"),
        F.when(edited("qty"), edit("qty")).otherwise(F.col("qty")).alias("qty"),
        F.when(edited("unit_price"), cents_or_null(edit("unit_price"))).otherwise(F.col("unit_cents")).alias("unit_cents"),
        F.when(edited("total"), cents_or_null(edit("total"))).otherwise(F.col("total_cents")).alias("total_cents"),
    )
    kept = patched.filter(F.coalesce("description", F.lit("")) != "")
    lines = kept.groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("n", "description", "qty", "unit_cents", "total_cents"))).alias("lines"))
    return lines.select("receipt_id", F.posexplode("lines").alias("at", "l")).select("receipt_id", (F.col("at") + 1).alias("line_no"), "l.description", "l.qty", "l.unit_cents", "l.total_cents")


def project_receipts(receipts: DataFrame, extractions: DataFrame, corrections: DataFrame, rules: Rules, kept: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> tuple[DataFrame, DataFrame]:
    """(transactions, line items). Hand edits outweigh rules, rules the extraction's own category.

    What both are made of, and the items that transactions are compared with, may be kept: storage.once evaluates them once for both.
    """
    bases = receipts.select("receipt_id").join(chosen_extractions(extractions), "receipt_id", "left").withColumn("p", receipt(F.col("best.payload")))
    bases = kept(bases.withColumn("p", F.when(F.col("best").isNotNull(), F.col("p"))).withColumn("extraction_id", F.col("best.extraction_id")).drop("best"), "receipt-bases")
    items = kept(project_items(bases.filter("p is not null"), corrections), "items")
    sums = items.groupBy("receipt_id").agg(F.sum("total_cents").alias("item_cents"), (F.count(F.lit(1)) == F.count("total_cents")).alias("all_priced"))
    rows = bases.join(last_edits(corrections, "receipt_id", RECEIPT_FIELDS, ["created_at", "id"]), "receipt_id", "left").join(sums, "receipt_id", "left")
    plain = lambda f: F.when(edited(f), edit(f)).otherwise(F.col(f"p.{f}"))
    money = lambda f: F.when(edited(f), cents_or_null(edit(f))).otherwise(cents_or_null(F.col(f"p.{f}")))
    rows = rows.withColumns({
        "merchant": plain("merchant"),
        "merchant_location": plain("merchant_location"),
        "purchased_on": F.when(edited("purchased_on"), iso_date(edit("purchased_on"))).otherwise(F.col("p.purchased_on")),
        "currency": F.coalesce(plain("currency"), F.lit("USD")),
        **{f"{f}_cents": money(f) for f in ("subtotal", "tax", "tip", "total")},
        "deleted": truthy(F.col("edit_deleted")["value"]),
    })
    rows = rows.withColumns({"category": F.when(edited("category"), edit("category")).otherwise(F.coalesce(rules.categories.match(F.col("merchant")), F.col("p.category"))), "merchant_key": merchant_key(F.col("merchant"))})
    missing = F.concat_ws(", ", F.when(F.col("merchant").isNull(), "merchant"), F.when(F.col("total_cents").isNull(), "total"), F.when(F.col("purchased_on").isNull(), "date"))
    nothing = F.col("merchant").isNull() & F.col("total_cents").isNull() & F.col("purchased_on").isNull()
    parts = F.col("item_cents") + F.coalesce("tax_cents", F.lit(0)) + F.coalesce("tip_cents", F.lit(0))
    off = F.coalesce(F.col("all_priced") & (F.abs(parts - F.col("total_cents")) > TOLERANCE_CENTS), F.lit(False))
    decimals = lambda c: F.format_string("%.2f", c.cast("double") / 100)
    result = (
        F.when(nothing & F.col("all_failed").isNull(), _result("pending", F.lit("not extracted yet")))
        .when(nothing & F.col("all_failed"), _result("failed", F.coalesce(F.nullif("last_note", F.lit("")), F.lit("extraction failed"))))
        .when(nothing, _result("pending", F.lit("no usable extraction")))
        .when(missing != "", _result("needs_review", F.concat(F.lit("missing "), missing)))
        .when(off, _result("needs_review", F.concat(F.lit("items + tax + tip = "), decimals(parts), F.lit(", receipt says "), decimals(F.col("total_cents")))))
        .otherwise(_result("ok", F.lit(None).cast("string")))
    )
    rows = rows.withColumn("r", result)
    return rows.select("receipt_id", "extraction_id", "merchant", "merchant_key", "merchant_location", "purchased_on", "currency", "subtotal_cents", "tax_cents", "tip_cents", "total_cents", "category", "r.status", "r.review_reason", "deleted"), items


def _result(status: str, reason):
    return F.struct(F.lit(status).alias("status"), reason.alias("review_reason"))


def work_queue(receipts: DataFrame, extractions: DataFrame) -> DataFrame:
    """Receipts without a successful extraction."""
    return receipts.join(extractions.filter("status = 'ok'").select("receipt_id"), "receipt_id", "left_anti").select("receipt_id")


def retry_schedule(attempts: DataFrame, by: list[str], first_seconds: int = RETRY_SECONDS, most_seconds: int = RETRY_MOST_SECONDS) -> DataFrame:
    """(by, failures, last_at, due_at): what failed since its last success, and when it is due again; nothing for what succeeded last.

    attempts: (by, id, created_at, status); the delay doubles with each failure in a row, from first_seconds up to
    most_seconds. Attempts of one time come by id, those without a time before all others; a success is status `ok`.
    Both steps are partial aggregations, so an item with most of the attempts is no task of its own.
    """
    order = F.struct("created_at", "id")
    last_ok = attempts.groupBy(*by).agg(F.max(F.when(F.col("status") == "ok", order)).alias("__ok"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"a.{b}").eqNullSafe(F.col(f"o.{b}"))
    since = attempts.alias("a").join(last_ok.alias("o"), same).filter(F.col("__ok").isNull() | (F.struct("a.created_at", "a.id") > F.col("__ok")))
    told = since.groupBy(*[F.col(f"a.{b}").alias(b) for b in by]).agg(F.count(F.lit(1)).alias("failures"), F.max(F.col("a.created_at").cast("timestamp")).alias("last_at"))
    steps = F.least(F.col("failures") - 1, F.lit(40))  # beyond that any delay is over the most
    delay = F.least(F.lit(first_seconds) * F.pow(F.lit(2.0), steps), F.lit(float(most_seconds))).cast("bigint")
    return told.withColumn("due_at", F.timestamp_micros(F.unix_micros("last_at") + delay * 1_000_000))

"""Filter interaction audit: what each filter removes, alone and after any others, for every order of them.

A document's failures are a bit mask. Masks are counted per part; a subset-zeta transform turns the counts into
the survivors of every subset of the filters; a step of an order is the difference of two neighbouring subsets.
The documents are read once, and no order is ever run.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
MEASURES = ("n", "good", "toxic")
_SPACES = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The maximal runs of characters other than \\x20 and \\x09-\\x0D, as an array."""
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def text_failures(text: Column) -> list[Column]:
    """A to D of a non-null text: few words, repetitive words, many capitals, odd symbols."""
    w = words(text)
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_hash, mask): mask holds A to D as bits 0 to 3; null texts are empty, null languages the part ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(text_failures(F.col("text")))), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_hash"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the five filters they fail, one row a part and mask that occur.

    E is bit 4: the text is that of a smaller doc_id. A row without an id is neither smaller nor larger than another.
    Repeated rows count each. An id is good (toxic) if any of its label rows has quality (toxic) 1; without one, it isn't.
    Only ids, hashes and masks are shuffled. Copies are summed before they meet: one text may be a third of all rows.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    told = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")).withColumn("salt", F.lit(0))
    label = lambda c: F.coalesce(c, F.lit(0))
    rows = failure_masks(docs).groupBy("doc_id", "part", "text_hash", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("text_hash")).otherwise(0)).join(told, ["doc_id", "salt"], "left")  # rows without ids spread
    copies = rows.groupBy("text_hash", "part", "mask", label(F.col("quality")).alias("good"), label(F.col("toxic")).alias("toxic")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    smallest = F.min("first").over(Window.partitionBy("text_hash"))
    original = F.when(F.col("first") == smallest, F.col("at_first")).otherwise(0) + F.col("nameless")
    split = copies.withColumn("own", original).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("c"))
    return split.filter("c.n > 0").groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def zeta(counts: DataFrame, filters: int) -> DataFrame:
    """(part, n, good, toxic): each measure as an array of 2^filters sums, at index s over all masks within s.

    One step a filter, each adding the half without its bit to the half with it. A part is one row of 3 * 2^filters numbers.
    """
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("cells")
    every = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    cell = lambda c: F.transform(every, lambda m: F.coalesce(F.col("cells")[m][c], F.lit(0).cast("long"))).alias(c)
    table = counts.groupBy("part").agg(cells).select("part", *[cell(c) for c in MEASURES])
    added = lambda c, bit: F.transform(c, lambda x, s: F.when(s.bitwiseAND(bit) > 0, x + F.col(c)[s - bit]).otherwise(x)).alias(c)
    for b in range(filters):
        table = table.select("part", *[added(c, 1 << b) for c in MEASURES])
    return table


def order_steps(letters: Sequence[str]) -> list[tuple[str, int, int, int, int]]:
    """(order, step, filters before, filters after, the step's own bit) for all orders: n! times n rows, of the filters alone."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), step, before, before | 1 << f, 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    The survivors of a set of filters are the documents whose failures lie within the other filters, so the transform's
    array, reversed, has them by set. An empty table has no part, so no row.
    """
    k = len(LETTERS)
    every = (1 << k) - 1
    table = zeta(mask_counts(docs, labels), k).select("part", *[F.reverse(c).alias(c) for c in MEASURES])
    n, weights = F.col("n"), F.array(*[F.lit(factorial(size) * factorial(k - 1 - size)) for size in range(k)])

    def removed_in_all_orders(bit: Column) -> Column:
        """Each set without the filter, times the orders in which just that set comes before it."""
        times = lambda s: F.when(s.bitwiseAND(bit) == 0, (n[s] - n[s.bitwiseOR(bit)]) * weights[F.bit_count(s)]).otherwise(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(every)), F.lit(0).cast("long"), lambda total, s: total + times(s))

    table = table.withColumn("shapley", F.transform(F.array(*[F.lit(1 << f) for f in range(k)]), removed_in_all_orders))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(bit).alias("bit")) for o, s, b, a, bit in order_steps(LETTERS)])
    rows = table.select("*", F.inline(steps))
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    bit = F.col("bit")
    return rows.select(
        "part", "filter_order", "step", n[F.col("after")].alias("kept"), lost("n").alias("removed"), (n[0] - n[bit] - lost("n")).alias("redundant"), (n[every - bit] - n[every]).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.log2(bit).cast("int")].alias("shapley"),
    )


#: The same from counts alone: each order's step sums the masks that it meets, without any transform.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), told AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM w LEFT JOIN told USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
l AS (SELECT chr(65 + i::INT) AS x, 1 << i::INT AS bit FROM range(5) r(i)),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, k::INT AS step, l.bit, coalesce((SELECT sum(p.bit) FROM l p WHERE position(p.x IN filter_order) < k), 0)::INT AS before
  FROM o, range(1, 6) r(k), l WHERE position(l.x IN filter_order) = k
), r AS (
  SELECT part, filter_order, step, s.bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | s.bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & s.bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & s.bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = s.bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & s.bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & s.bit > 0), 0) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

"""Vector code compression: each quarter of a vector becomes the index of its nearest codebook entry.

Components are integers (floor of 1024 x), so that every sum and distance is exact and the result doesn't depend on how
the rows are dealt to tasks. A round broadcasts the codebooks, assigns whole Arrow batches at once and merges the entries'
sums in a grouped shuffle; the driver sees codebooks alone, whose size the vectors' length fixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to a codebook are in memory at once.
STEP = 2048
#: That many labels at most are broadcast with their sums; each of the others has less than one row in that many.
LABELS = 4096
CODES = "vec_id long, code string, error long, label int"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values): which rows are kept, their lengths, and floor(1024 x) of all their components in order.

    Dropped are null vectors and those with a null, infinite or not-a-number component.
    """
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)  # flatten() skips null lists
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    kept = (bad[ends] == bad[ends - lengths]) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        whole = np.floor(x[np.repeat(kept, lengths)] * SCALE)
    return np.flatnonzero(kept), lengths[kept], whole


def matrix(lengths: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """One row a vector, filled up with zeros to width."""
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values.astype(np.int64)
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of each row's nearest entry, the first of equal ones; |r|^2 - 2 r.e + |e|^2 in 64-bit integers."""
    d = (entries * entries).sum(1) - 2 * (rows @ entries.T)
    best = d.argmin(1)
    return best, d[np.arange(len(rows)), best] + (rows * rows).sum(1)


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most STEP kept rows with their integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            rows, lengths, values = integers(part.column(part.schema.get_field_index("embedding")))
            if len(rows):
                yield part.take(pa.array(rows)), matrix(lengths, values, width)


def _survey(vectors: DataFrame) -> tuple[int, list[int]]:
    """(length of the vectors, smallest ids), in one pass without a shuffle of vectors: a task tells of at most ENTRIES ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, longest, largest = np.zeros(0, np.int64), 0, 0.0
        for batch in batches:
            rows, lengths, values = integers(batch.column(1))
            own = pc.drop_null(batch.column(0).take(pa.array(rows))).to_numpy(zero_copy_only=False)
            ids = np.unique(np.concatenate([ids, own]))[:ENTRIES]
            longest = max(longest, int(lengths.max(initial=-1)))
            largest = max(largest, float(np.abs(values).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([longest]), pa.array([largest])], names=["ids", "longest", "largest"])

    told = materialize(vectors.select("vec_id", "embedding").mapInArrow(run, "ids array<long>, longest long, largest double"), "vector-survey")
    most = told.agg(F.max("longest").alias("longest"), F.max("largest").alias("largest")).first()
    width = -(-(most["longest"] or 0) // PARTS) * PARTS
    # a distance is at most width * (2 * largest)^2, and it must be below 2^63
    if width * (2 * (most["largest"] or 0)) ** 2 >= 2.0**62:
        raise ArithmeticError(f"components up to {most['largest'] / SCALE:g} don't have exact distances in 64 bits at length {width}")
    ids = [r["id"] for r in told.select(F.explode("ids").alias("id")).distinct().orderBy("id").limit(ENTRIES).collect()]
    return width, ids


def start(vectors: DataFrame) -> np.ndarray:
    """First codebooks, [part, entry, position]: the vectors of the smallest kept ids; of an id's different vectors, the smallest."""
    width, ids = _survey(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches, width):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "x"])

    chosen = vectors.filter(F.col("vec_id").isin(ids)).select("vec_id", "embedding").mapInArrow(run, "vec_id long, x array<long>") if ids else None
    rows = [r["x"] for r in chosen.groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()] if ids else []
    return np.array(rows, np.int64).reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def refine(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it; an entry without any stays."""
    parts, entries, size = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums, counts = np.zeros_like(own), np.zeros((parts, entries), np.int64)
        for _, x in _batches(batches, parts * size):
            for p in range(parts):
                piece = x[:, p * size : (p + 1) * size]
                best, _ = nearest(piece, own[p])
                np.add.at(sums[p], best, piece)
                counts[p] += np.bincount(best, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    told = vectors.select("embedding").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    out = books.copy()
    for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
    shared.unpersist()
    return out


def train(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    books = start(vectors)
    for _ in range(rounds if books.size else 0):
        books = refine(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """CODES of every kept row; without codebooks (no row with an id), code and error are null."""
    parts, entries, size = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _batches(batches, parts * size):
            found = [nearest(x[:, p * size : (p + 1) * size], shared.value[p]) for p in range(parts)] if entries else []
            code = [b.tobytes().hex() for b in np.stack([f[0] for f in found], 1).astype(np.uint8)] if entries else [None] * len(x)
            error = pa.array(sum(f[1] for f in found)) if entries else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code, pa.string()), error, part.column(2)], names=["vec_id", "code", "error", "label"])

    return vectors.mapInArrow(run, CODES)


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all components, by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of embeddings (vec_id, embedding, label).

    A vector shorter than the longest, or a length that isn't a multiple of four, is filled up with zeros. Repeated rows
    count each, and as one first entry; rows without an id are coded, but no first entry. Null labels are one label. An
    empty table gives no rows. Components so large that a distance could leave 64 bits are an error.
    """
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    books = train(vectors)
    coded = materialize(encode(vectors, books), "vector-codes").withColumnRenamed("label", "__label")
    sums = materialize(coded.groupBy(F.col("__label").alias("label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    size = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n")).first()
    few = size["labels"] <= LABELS
    hot = F.broadcast(sums if few else sums.filter(F.col("n") * LABELS > size["n"]))
    same = F.col("__label").eqNullSafe(F.col("label"))
    out = coded.join(hot, same)
    if not few:  # labels with few rows each, which a shuffle deals evenly
        out = out.unionByName(coded.join(hot, same, "left_anti").join(sums.filter(F.col("n") * LABELS <= size["n"]), same))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: components as rows, each round a join with the codebooks."""
    exact_floor = "(s - ((s % n) + n) % n) // n"
    rounds, book = [], "b0"
    for r in range(ROUNDS + 1):
        rounds.append(f"d{r} AS MATERIALIZED (SELECT vec_id, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN {book} USING (p, i) GROUP BY 1, 2, 3)")
        rounds.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM d{r} GROUP BY 1, 2)")
        if r < ROUNDS:
            rounds.append(f"m{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY 1, 2, 3)")
            rounds.append(f"b{r + 1} AS MATERIALIZED (SELECT p, e, i, CASE WHEN n IS NULL THEN c ELSE {exact_floor} END AS c FROM {book} LEFT JOIN m{r} USING (p, e, i))")
            book = f"b{r + 1}"
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), flat AS (SELECT vec_id, rank, len(embedding) // {PARTS} AS size, unnest(range(len(embedding))) AS k, floor({SCALE} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
x AS MATERIALIZED (SELECT vec_id, rank, k // size AS p, k % size AS i, x FROM flat),
b0 AS MATERIALIZED (SELECT p, rank AS e, i, x AS c FROM x WHERE rank < {ENTRIES}),
{", ".join(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM {book})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


SQL = _sql()

"""Token counts of documents in flat token files that have no index.

A flat file is a run of 16-bit token ids with an end-of-document id after each document, cut into blocks
of fixed size without regard to documents. Each block is searched for the end id at once (vectorised), and
documents that run over block edges are stitched by a prefix scan over one small row a block: how many
ends came before, and how many tokens stand open. The scan has two levels, so that a single file may hold
any share of the data: no task ever holds more than SUPER rows of one file's blocks.

Null and empty texts count 0 tokens. Repeated rows count alike; a null doc_id stays null. A file whose last document has no end id
still has it counted. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.storage import materialize
from ledgerline.llm.textarrays import text_slices
from ledgerline.llm.wordtokens import word_tokenizer

END_ID = 49407
BLOCK_BYTES = 1 << 20
SUPER = 4096
STREAM = "file long, block long, data binary, ids array<long>, first_ordinal long"


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """STREAM: each partition of docs as one flat file in blocks; rows with ids name the documents in order, as a list apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, block, ordinal, held = TaskContext.get().partitionId(), 0, 0, b""
        tokens = word_tokenizer(tokenizer_path, special_as_text=True)
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["file", "block", "data", "ids", "first_ordinal"])
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text", 1 << 20):
                ids, first = tokens.encode(buf, offsets)
                held += np.insert(ids.astype("<u2"), first[1:], np.uint16(end_id)).tobytes()
                rows = [(file, None, None, part.column(0).to_pylist(), ordinal)]
                ordinal += len(part)
                while len(held) >= block_bytes:
                    rows.append((file, block, held[:block_bytes], None, None))
                    held, block = held[block_bytes:], block + 1
                yield make(rows)
        if held:
            yield make([(file, block, held, None, None)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STREAM)


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of existing flat files under path, each at most as large as one binaryFile row may be (2 GiB). file is the path's xxhash64; empty files have no blocks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                for n in range(0, len(data), block_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([n // block_bytes], pa.int64()), pa.array([bytes(data[n : n + block_bytes])])], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("file"), "content").mapInArrow(cut, "file long, block long, data binary")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """One row a block: its tokens, ends, the tokens after its last end, and the lengths that its ends close (the first lacks what came before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == end_id)
                gaps = np.diff(ends, prepend=-1) - 1
                rows.append((file, block, len(ids), len(ends), len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids), gaps))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 5, pa.list_(pa.int64())), strict=True)], names=["file", "block", "n", "ends", "open", "gaps"])

    return blocks.filter("data is not null").select("file", "block", "data").mapInArrow(run, "file long, block long, n long, ends long, open long, gaps array<long>")


def _exclusive(df: DataFrame, by: list[str], order: str, ends: str, open_: str, prefix: str) -> DataFrame:
    """Prefix scan: ends before each row, and tokens left open before it since the last end (within by, or since by's start)."""
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(f"{prefix}_run", F.sum((F.col(ends) > 0).cast("long")).over(w))
    df = df.withColumn(f"{prefix}_sum", F.sum(open_).over(Window.partitionBy(*by, f"{prefix}_run").orderBy(order)))
    return df.withColumns({f"{prefix}_ends": F.coalesce(F.sum(ends).over(before), F.lit(0)), f"{prefix}_open": F.coalesce(F.lag(f"{prefix}_sum").over(w), F.lit(0))}).drop(f"{prefix}_run", f"{prefix}_sum")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, from scan_blocks()."""
    small = scanned.select("file", F.floor(F.col("block") / SUPER).alias("super"), "block", "ends", "open")
    inner = _exclusive(small, ["file", "super"], "block", "ends", "open", "in")
    whole = small.groupBy("file", "super").agg(F.sum("ends").alias("ends"), F.max("block").alias("last"))
    tails = inner.select("file", "super", F.col("block").alias("last"), F.when(F.col("ends") > 0, F.col("open")).otherwise(F.col("open") + F.col("in_open")).alias("open"))
    outer = _exclusive(whole.join(tails, ["file", "super", "last"]), ["file"], "super", "ends", "open", "out")
    # a row's open tokens: its own super's, and those before the super if no end came in between
    placed = inner.join(outer.select("file", "super", "out_ends", "out_open"), ["file", "super"]).select("file", "block", (F.col("in_ends") + F.col("out_ends")).alias("before"), (F.col("in_open") + F.when(F.col("in_ends") == 0, F.col("out_open")).otherwise(0)).alias("carried"))
    docs = scanned.join(placed, ["file", "block"]).select("file", "before", "carried", F.posexplode("gaps").alias("k", "gap"))
    closed = docs.select("file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("gap") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"))
    rest = outer.groupBy("file").agg(F.max_by(F.struct((F.col("out_ends") + F.col("ends")).alias("ordinal"), (F.col("open") + F.when(F.col("ends") == 0, F.col("out_open")).otherwise(0)).alias("n_tokens")), "super").alias("x")).select("file", "x.*")
    return closed.unionByName(rest.filter("n_tokens > 0"))


def count_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens): docs written flat into the shared folder, scanned and stitched."""
    flat = materialize(write_flat(docs, tokenizer_path, end_id, block_bytes), "flat-tokens")
    counts = stitch(materialize(scan_blocks(flat, end_id), "flat-scan"))
    ids = flat.select("file", "first_ordinal", F.posexplode("ids").alias("at", "doc_id")).select("file", (F.col("first_ordinal") + F.col("at")).alias("ordinal"), "doc_id")
    return ids.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")

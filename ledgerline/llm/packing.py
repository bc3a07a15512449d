"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are packed best-fit within partitions. Bins that are nearly full leave at once; the others become
items of the next round, in fewer and larger groups, where best-fit joins them. Each group is bounded by
`group_items`, so no task sees all bins. Rounds end when one group holds all open bins, when a round saves
fewer than one bin in a hundred, or after `most_rounds`; all pieces are packed by then. What moves between
tasks is (bin, length) only, never ids.

Null texts count as empty: their one token is the end token. Repeated rows, and rows without an id, are packed
as rows of their own.
Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.storage import discard, materialize
from ledgerline.llm.textarrays import text_slices
from ledgerline.llm.wordtokens import word_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece of each document's ids (with end_id after them): PIECES. Only documents longer than capacity are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_path)
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text", 1 << 20):
                ids, first = tokens.encode(buf, offsets)
                rows = []
                for doc, lo, hi in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(own), capacity)):
                        piece = own[at : at + capacity]
                        rows.append((doc, n, at, len(piece), zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still holds it."""
    bins = np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the distinct sizes of room, ascending: capacity at most
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            left = rooms[at]
            own = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            own, left, opened = opened, capacity, opened + 1
        bins[i] = own
        left -= need
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append(own)
    return bins


def pack(pieces: DataFrame, capacity: int = 4096, nearly_full: float = 0.995, group_items: int = 50_000, most_rounds: int = 6) -> DataFrame:
    """pieces (columns of PIECES, others kept) with sequence_id and offset: sequences of `capacity` tokens at most."""
    enough = int(capacity * nearly_full)
    # round 0 packs each partition of the pieces where it lies, in runs of group_items
    frozen = T.StructType([*pieces.schema.fields, T.StructField("bin", T.LongType()), T.StructField("place", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, runs = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal runs
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("length").to_numpy()
            bins = best_fit(lengths, capacity)
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[order]) - lengths[order]
            head = np.r_[True, np.diff(bins[order]) > 0]
            place = np.empty(len(bins), np.int64)
            place[order] = before - np.repeat(before[head], np.diff(np.r_[np.flatnonzero(head), len(bins)]))
            base = (task << 40) | (runs << 24)
            runs += 1
            out = table.append_column("bin", pa.array(base + bins)).append_column("place", pa.array(place))
            held.clear()
            return out.combine_chunks().to_batches()[0]

        n = 0
        for batch in batches:
            for at in range(0, len(batch), group_items):
                held.append(batch.slice(at, group_items))
                n += len(held[-1])
                if n >= group_items:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    packed = materialize(pieces.mapInArrow(local, frozen), "pack-local")
    fill = packed.groupBy("bin").agg(F.sum("length").cast("long").alias("fill"), F.count(F.lit(1)).alias("items"))
    fill = materialize(fill, "pack-fill")
    # where (the bin it now is in, and its offset there) for bins that a later round moved
    open_bins = fill.filter(F.col("fill") < enough).select(F.col("bin").alias("item"), F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"), "fill")
    open_bins = first_open = materialize(open_bins, "pack-open")
    discard(fill)
    moved, count, step = [], open_bins.count(), 0
    while count > 1 and step < most_rounds:
        step += 1
        groups = max(1, -(-count // group_items))
        merged = materialize(_merge(open_bins, groups, step, capacity), f"pack-round{step}")
        left = merged.agg(F.sum((F.col("fill") > 0).cast("long")).alias("bins"), F.sum(((F.col("fill") > 0) & (F.col("fill") < enough)).cast("long")).alias("open")).first()
        moved.append(merged)
        if left["bins"] > 0.99 * count or groups == 1:
            break
        keep = merged.filter((F.col("fill") > 0) & (F.col("fill") < enough)).select(F.col("root").alias("item"), "root", F.lit(0).cast("long").alias("shift"), "fill")
        open_bins, count = keep, int(left["open"] or 0)
    out = packed.withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("place"))
    for merged in moved:
        step_to = merged.select(F.col("item").alias("sequence_id"), "root", "shift")
        out = out.join(step_to, "sequence_id", "left").withColumns({"sequence_id": F.coalesce("root", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}).drop("root", "shift")
    discard(first_open)
    return out.select(*pieces.columns, "sequence_id", "offset")


def _merge(open_bins: DataFrame, groups: int, step: int, capacity: int) -> DataFrame:
    """Best-fit of bins as items within groups: (item, root: the bin it goes to, shift: its offset there, fill of root on root's own row, else 0)."""

    def join(pdf):
        bins = best_fit(pdf["fill"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        items, fills, own = pdf["item"].to_numpy()[order], pdf["fill"].to_numpy()[order], bins[order]
        head = np.r_[True, np.diff(own) > 0]
        sizes = np.diff(np.r_[np.flatnonzero(head), len(own)])
        before = np.cumsum(fills) - fills
        total = np.add.reduceat(fills, np.flatnonzero(head))
        import pandas as pd

        return pd.DataFrame({"item": items, "root": np.repeat(items[head], sizes), "shift": before - np.repeat(before[head], sizes), "fill": np.where(head, np.repeat(total, sizes), 0)})

    salt = F.pmod(F.xxhash64("item", F.lit(step)), F.lit(groups)).alias("salt")
    return open_bins.select("item", "fill", salt).groupBy("salt").applyInPandas(join, "item long, root long, shift long, fill long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenize, cut and pack whole documents; ids are encoded once, into the shared folder."""
    return pack(materialize(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)

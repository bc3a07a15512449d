"""Exact repeats of `length` bytes, by merging the Burrows-Wheeler transforms of shards.

Every string of `length` bytes has one anchor: the leftmost of its smallest KMER-byte hashes. Equal strings
have equal anchors at equal places, so all that can be equal meets under one anchor hash, aligned by it.
A run is what starts one after another under one anchor in one text; equal runs are one class. A class that
stands at two places repeats as a whole, and only one text of it goes on; an anchor with one class is done.
The suffixes under an anchor are the aligned strings of its classes read from each column on.

A task gets the strings of many anchors in shards. Each shard's transform holds, column by
column from the right, its symbols in the order of the suffixes that follow. The shards are then merged by
refining an interleave: pass c takes each shard's symbols in turn as the interleave of pass c + 1 says and
parts them stably by symbol, so suffixes are never sorted again. With each neighbour goes the column at
which the two differ, the minimum over what lay between them: the common prefix. A string starting at c
repeats if one of its neighbours agrees for `length` columns or more.

Anchors with more than CROWD classes would crowd one task. Their runs are cut into pieces of some columns
(WIDTHS, at last one), and what all starts of a piece share, longer than the anchor, is the piece's anchor.
Pieces that are equal are one class again, so rows grow with the runs and never with their pairs.

Texts are UTF-8 bytes, matches never cross documents, null counts as empty, texts shorter than `length` have
nothing removed. Exact copies are found by hash and work enters once; all of a copied text is removed.
Identical repeated rows are copies. Rows without an id are treated like others. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import discard, materialize
from ledgerline.llm.textarrays import mix, prefix_hash, ragged, span_hash, text_slices

KMER = 32
CROWD = 2048
WIDTHS = (24, 1)
SHARD = 4096
LONG = 1 << 23
REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_PLACE = np.uint64((1 << 24) - 1)
END = 256  # a symbol that equals nothing, itself included


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for each full window."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, hash of the run's bytes, anchor, first start, last start) of runs of strings with one anchor; places count from the text's start."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if len(buf) < length:
        return none
    sums = prefix_hash(buf)
    at = np.arange(len(buf) - KMER + 1)
    h = span_hash(sums, at, at + KMER)
    least = _sliding_min((h & ~_PLACE) | at.astype(np.uint64), length - KMER + 1)
    anchor = (least & _PLACE).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    ok = np.arange(len(anchor)) + length <= offsets[text + 1]
    begins = ok.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~ok[:-1]
    ends = ok.copy()
    ends[:-1] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~ok[1:]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    t, base = text[s], offsets[text[s]]
    return t, h[anchor[s]], span_hash(sums, s, e + length), anchor[s] - base, s - base, e - base


def _parts(text: bytes, length: int, most: int = LONG) -> Iterator[tuple[int, bytes]]:
    """Overlapping parts of a very long text, such that each string lies in one."""
    for at in range(0, max(1, len(text) - length + 1), most - length + 1):
        yield at, text[at : at + most]


class Transform:
    """One shard: its strings' symbols, for each column, in the order of what follows them."""

    def __init__(self, groups: np.ndarray, columns: np.ndarray):
        """groups: sorted; columns: [column, string], END outside a string."""
        self.groups = groups
        self.symbols = np.empty_like(columns)
        self.orders: list[tuple[int, np.ndarray]] = []
        order = np.arange(len(groups))
        for c in range(len(columns) - 1, -1, -1):
            s = columns[c][order]
            self.symbols[c] = s
            at, new = _part(groups, s)
            if len(at):
                order[at] = order[at[new]]
        self.first_order = order


def _part(groups: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, order): the places of groups with several symbols, and the stable order by symbol within each group."""
    odd = np.zeros(len(groups), bool)
    odd[1:] = (groups[1:] == groups[:-1]) & ((symbols[1:] != symbols[:-1]) | (symbols[1:] == END))
    if not odd.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(int(groups[-1]) + 1, bool)
    mixed[groups[odd]] = True
    at = np.flatnonzero(mixed[groups])
    return at, np.argsort(groups[at] * (END + 1) + symbols[at], kind="stable")


def merge(shards: list[Transform], rows: list[np.ndarray], lo: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """[column, string] True where the string of `length` symbols that starts there also starts in another string of its group.

    rows[k]: the numbers of shard k's strings; lo, last: the columns of each string's first and last start.
    """
    width = len(shards[0].symbols)
    groups = np.concatenate([s.groups for s in shards])
    source = np.repeat(np.arange(len(shards)), [len(s.groups) for s in shards])
    place = np.argsort(groups, kind="stable")
    groups, shard = groups[place], source[place]  # the interleave: which shard each suffix comes from
    row = np.concatenate(rows)[place]
    differ = np.full(len(groups), width)
    head = np.r_[True, groups[1:] != groups[:-1]]
    found = np.zeros((int(last.max(initial=-1)) + 1, len(groups)), bool)
    turn = [np.flatnonzero(shard == k) for k in range(len(shards))]
    for c in range(width - 1, -1, -1):
        symbols = np.empty(len(groups), shards[0].symbols.dtype)
        for k, s in enumerate(shards):
            symbols[turn[k]] = s.symbols[c]
        at, new = _part(groups, symbols)
        if len(at):
            old = differ[at]
            old[head[at]] = -1  # nothing is shared over a group's edge
            pair = np.stack([new[:-1] + 1, new[1:] + 1], 1)
            same = np.r_[False, (groups[at][new][1:] == groups[at][new][:-1]) & (symbols[at][new][1:] == symbols[at][new][:-1]) & (symbols[at][new][1:] != END)]
            d = np.full(len(at), c)
            if same.any():
                use = pair[same[1:]]
                d[same] = np.minimum.reduceat(np.append(old, width), use.reshape(-1))[::2]
            differ[at] = d
            row[at], shard[at] = row[at[new]], shard[at[new]]
            turn = [np.flatnonzero(shard == k) for k in range(len(shards))]
        if c < len(found):
            near = differ - c >= length
            near[head] = False
            near[:-1] |= near[1:]
            hit = row[near]
            hit = hit[(lo[hit] <= c) & (c <= last[hit])]
            found[c, hit] = True
    return found


def repeated_starts(keys: np.ndarray, lead: np.ndarray, starts: np.ndarray, buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of runs of repeated starts, counted within each string.

    keys: anchor hashes; lead: bytes before the anchor; starts: how many starts a string has; its bytes are
    buf[offsets[i]:offsets[i + 1]].
    """
    order = np.argsort(keys, kind="stable")
    group_of = np.unique(keys, return_inverse=True)[1]
    reach = length - KMER
    lo = reach - lead
    last = lo + starts - 1
    width = reach + length
    shards, rows = [], []
    for at in range(0, len(order), SHARD):
        own = order[at : at + SHARD]
        columns = np.full((width, len(own)), END, np.int16)
        n = offsets[own + 1] - offsets[own]
        columns[ragged(lo[own], n), np.repeat(np.arange(len(own)), n)] = buf[ragged(offsets[own], n)]
        shards.append(Transform(group_of[own], columns))
        rows.append(own)
        del columns
    found = merge(shards, rows, lo, last, length)
    # rows of `found` follow the merged numbering of strings
    padded = np.zeros((len(found) + 2, found.shape[1]), np.int8)
    padded[1:-1] = found
    step = np.diff(padded, axis=0)
    a, ra = np.nonzero((step == 1).T)[::-1]
    b, rb = np.nonzero((step == -1).T)[::-1]
    return ra, a - lo[ra], b - 1 - lo[rb]


RUNS = "thash long, h long, d long, lead int, s long, e long"


def runs_table(docs: DataFrame, length: int) -> DataFrame:
    """RUNS of each text (thash, text): anchor hash, hash of the bytes, bytes before the anchor, first and last start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text", 1 << 20):
                t, h, d, p, s, e = _long(buf, length) if len(part) == 1 and len(buf) >= LONG else anchor_runs(buf, offsets, length)
                columns = [part.column(0).take(pa.array(t)), pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array((p - s).astype(np.int32)), pa.array(s), pa.array(e)]
                yield pa.RecordBatch.from_arrays(columns, names=["thash", "h", "d", "lead", "s", "e"])

    return docs.select("thash", "text").mapInArrow(run, RUNS)


def _long(buf: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    found = []
    for at, part in _parts(buf.tobytes(), length):
        t, h, d, p, s, e = anchor_runs(np.frombuffer(part, np.uint8), np.array([0, len(part)]), length)
        found.append((t, h, d, p + at, s + at, e + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def classes_of(runs: DataFrame) -> DataFrame:
    """(h, d, many, thash, lead, s, e): one place of each class of equal runs, and whether it stands at several. Copies of a text are one place."""
    place = F.struct("thash", "s")
    many = F.min(place) != F.max(place)
    if "many" in runs.columns:  # pieces of a class that stands at several places
        many = many | F.max("many")
    rows = runs.groupBy("h", "d").agg(F.min(F.struct("thash", "s", "lead", "e")).alias("at"), many.alias("many"))
    return rows.select("h", "d", "many", "at.thash", "at.lead", "at.s", "at.e")


def _of_texts(texts: DataFrame, wanted: DataFrame, schema: str, make) -> DataFrame:
    """Rows that make(raw bytes, thash, wanted rows of that text) yields, for the runs `wanted`."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for thash, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for row in make(raw, thash, own):
                    out.append(row)
                    size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    lists = wanted.groupBy("thash").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "thash"])).alias("runs"))
    return texts.join(lists, "thash").select("thash", "text", "runs").mapInArrow(run, schema)


def _strings(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(h, d, lead, starts, data): the bytes of classes."""

    def make(raw: bytes, thash: int, own: list[dict]) -> Iterator[tuple]:
        for r in own:
            yield r["h"], r["d"], r["lead"], r["e"] - r["s"] + 1, raw[r["s"] : r["e"] + length]

    return _of_texts(texts, classes.select("thash", "h", "d", "lead", "s", "e"), "h long, d long, lead int, starts long, data binary", make)


def _pieces(texts: DataFrame, classes: DataFrame, length: int, width: int) -> DataFrame:
    """(ph, pd, off, many, thash, h, d, lead, s, e): runs of at most `width` columns that make up the classes (ph, pd), off starts after their first."""
    reach = length - KMER

    def make(raw: bytes, thash: int, own: list[dict]) -> Iterator[tuple]:
        for r in own:
            first = reach - r["lead"]  # the column of the run's first start
            data = np.frombuffer(raw, np.uint8)[r["s"] : r["e"] + length]
            sums = prefix_hash(data)
            n = r["e"] - r["s"] + 1
            edges = np.unique(np.r_[first, np.arange(first // width * width + width, first + n, width), first + n])
            lo, hi, column = edges[:-1] - first, edges[1:] - first, edges[:-1] // width  # starts [lo, hi) of the run
            core = span_hash(sums, (column + 1) * width - 1 - first, column * width + length - first)
            h = mix(core ^ mix(column.astype(np.uint64) + np.uint64(r["h"] & (1 << 64) - 1))).view(np.int64)
            d = span_hash(sums, lo, hi - 1 + length).view(np.int64)
            for k in range(len(lo)):
                yield r["h"], r["d"], int(lo[k]), r["many"], thash, int(h[k]), int(d[k]), r["lead"] - int(lo[k]), r["s"] + int(lo[k]), r["s"] + int(hi[k]) - 1

    return _of_texts(texts, classes.select("thash", "h", "d", "many", "lead", "s", "e"), "ph long, pd long, off long, many boolean, thash long, h long, d long, lead int, s long, e long", make)


def _merged(strings: DataFrame, length: int) -> DataFrame:
    """(h, d, a, b): repeated starts a .. b of the classes of one anchor, counted from the class's first."""

    def found(table: pa.Table) -> pa.RecordBatch:
        data = table.column("data").combine_chunks()
        data = (data.chunk(0) if isinstance(data, pa.ChunkedArray) else data).cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        keys = table.column("h").to_numpy()
        r, a, b = repeated_starts(keys.view(np.uint64), table.column("lead").to_numpy().astype(np.int64), table.column("starts").to_numpy(), np.frombuffer(data.buffers()[2], np.uint8), offsets, length)
        return pa.RecordBatch.from_arrays([pa.array(keys[r]), pa.array(table.column("d").to_numpy()[r]), pa.array(a), pa.array(b)], names=["h", "d", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # anchors in turns, so that memory follows a bounded number of strings and no anchor is parted
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 2 * SHARD:
                table = pa.Table.from_batches(held)
                keys = table.column("h").to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
                if cut:
                    yield found(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), n - cut
        if n:
            yield found(pa.Table.from_batches(held))

    return strings.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, d long, a long, b long")


def _repeats(texts: DataFrame, classes: DataFrame, length: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(h, d, a, b), stored: repeated starts a .. b of classes, counted from the class's first."""
    kinds = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "anchors")
    met = materialize(classes.join(kinds, "h"), "met")
    discard(kinds)
    whole = classes.filter("many").select("h", "d", F.lit(0).cast("long").alias("a"), (F.col("e") - F.col("s")).alias("b"))
    crowded = met.filter(F.col("kinds") > CROWD)
    split = bool(widths) and not crowded.isEmpty()
    out = whole.unionByName(_merged(_strings(texts, met.filter(F.col("kinds") <= CROWD) if split else met, length), length))
    if split:
        pieces = materialize(_pieces(texts, crowded, length, max(1, min(widths[0], length // 4))), "pieces")
        parts = materialize(classes_of(pieces), "piece-classes")
        inner = _repeats(texts, parts, length, widths[1:])
        there = pieces.join(inner, ["h", "d"]).select(F.col("ph").alias("h"), F.col("pd").alias("d"), (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b"))
        out = materialize(out.unionByName(there), "repeats")
        discard(pieces, parts, inner)
    else:
        out = materialize(out, "repeats")
    discard(met)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = False) -> DataFrame:
    """REPORT of every document, and with keep_text what is left of its bytes (kept binary)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("thash", F.xxhash64("text", F.octet_length("text")))
    long_ones = docs.filter(F.octet_length("text") >= length).select("thash", "text")
    copies = long_ones.groupBy("thash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    runs = materialize(runs_table(long_ones, length), "runs")
    classes = materialize(classes_of(runs), "classes")
    found = _repeats(long_ones.dropDuplicates(["thash"]), classes, length)
    discard(classes)
    removed = runs.join(found, ["h", "d"]).groupBy("thash").agg(F.collect_set(F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + length).alias("b"))).alias("spans"))
    spans = materialize(removed.join(copies, "thash", "full"), "spans")
    discard(runs, found)
    schema = REPORT + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own, copied in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode()
                if copied:
                    own = [{"a": 0, "b": len(raw)}]
                at, spans, left = 0, 0, []
                for x in sorted(own or [], key=lambda x: x["a"]):
                    if x["a"] > at or not spans:
                        left.append(raw[at : x["a"]])
                        spans += 1
                    at = max(at, x["b"])
                left.append(raw[at:])
                rest = b"".join(left)
                row = (doc, len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest())
                rows.append((*row, rest) if keep_text else row)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if keep_text else []))
            names = [x.split()[0] for x in schema.split(", ")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.join(spans, "thash", "left").select("doc_id", "text", "spans", "copies").mapInArrow(run, schema)

"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last 7 bytes decides where chunks end: at level k, where its k lowest bits are zero, so a level's
boundaries are among those of the level below, and an insertion moves none but the nearest. A chunk's signature are 12
bits of a hash of its bytes in their windows. A text's level is the lowest with at most 64 chunks; its fingerprint is
that level and the signatures of three levels from there, so that texts up to two levels apart can still be compared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.llm.storage import materialize
from ledgerline.llm.textarrays import mix, text_slices

WINDOW, CHUNKS, LEVELS = 7, 64, 3
#: Bytes of a long text that are hashed at once.
BLOCK = 1 << 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[ALPHABET] = np.arange(64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, j, 2**64)) for j in range(WINDOW)]
_ONE = np.uint64(1)
SUMMARY = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = "edge string, segment string, sha binary, row long, text binary"


def rolling(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the up to 7 bytes that end at each byte and begin no earlier than the last of starts."""
    values = _BYTE[buf]
    out = values.copy()
    for j in range(1, min(WINDOW, len(buf))):
        out[j:] += values[:-j] * _STEPS[j]
    lengths = np.diff(np.append(starts, len(buf)))
    for place in range(WINDOW - 1):  # the first bytes of a text: take back what lies before it
        at = starts[lengths > place] + place
        for j in range(place + 1, WINDOW):
            inside = at[at >= j]
            out[inside] -= values[inside - j] * _STEPS[j]
    return mix(out)


def _letters(chunks: np.ndarray) -> str:
    """Two letters for each chunk's sum of hashes."""
    codes = (mix(chunks) >> np.uint64(52)).astype(np.int64)
    return np.stack([ALPHABET[codes >> 6], ALPHABET[codes & 63]], 1).tobytes().decode()


def _short(buf: np.ndarray, offsets: np.ndarray) -> list[str]:
    """All texts at once, level by level, until each has its three."""
    lengths = np.diff(offsets)
    n = len(lengths)
    hashes = rolling(buf, offsets[:-1])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + _ONE))])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    inner = np.ones(len(buf), bool)  # a text's last byte ends it anyway
    inner[offsets[1:][lengths > 0] - 1] = False
    text = np.repeat(np.arange(n), lengths)[inner]
    sums = (sums[1:] - np.repeat(sums[offsets[:-1]], lengths))[inner]
    hashes = hashes[inner]
    level = np.full(n, -1)
    parts: list[list[str]] = [[] for _ in range(n)]
    level[lengths == 0] = 0
    for k in range(64 + LEVELS):
        keep = (hashes & np.uint64((1 << k) - 1) == 0) & (level[text] < 0) if k < 64 else np.zeros(len(hashes), bool)
        text, hashes, sums = text[keep], hashes[keep], sums[keep]
        open_ = np.flatnonzero(level < 0)
        if not len(open_):
            break
        count = np.bincount(text, minlength=n)[open_]
        last = np.cumsum(count + 1) - 1
        at_end = np.zeros(len(text) + len(open_), bool)
        at_end[last] = True
        ends = np.empty(len(at_end), np.uint64)
        ends[~at_end], ends[at_end] = sums, total[open_]
        chunks = ends - np.concatenate([[np.uint64(0)], ends[:-1]])
        chunks[last - count] = ends[last - count]
        few = count < CHUNKS
        letters = _letters(chunks[np.repeat(few, count + 1)])
        at = 0
        for i, size in zip(open_[few].tolist(), (2 * (count[few] + 1)).tolist(), strict=True):
            parts[i].append(letters[at : at + size])
            at += size
            if len(parts[i]) == LEVELS:
                level[i] = k - LEVELS + 1
    return [f"{k}:{':'.join(p or [''] * LEVELS)}" for k, p in zip(level.tolist(), parts, strict=True)]


def _long(buf: np.ndarray, block: int) -> str:
    """One text, a block at a time: of each level only its first 65 chunks are kept."""
    before = np.uint64(0)
    chunks = [np.zeros(0, np.uint64) for _ in range(64 + LEVELS)]
    end = [before] * len(chunks)

    def add(k: int, sums: np.ndarray) -> None:
        if len(chunks[k]) <= CHUNKS:
            chunks[k] = np.concatenate([chunks[k], np.diff(sums[: CHUNKS + 1], prepend=end[k])])
        end[k] = sums[-1]

    for lo in range(0, len(buf), block):
        left = min(lo, WINDOW - 1)
        h = rolling(buf[lo - left : lo + block], np.zeros(1 if lo == 0 else 0, np.int64))[left:]
        s = before + np.cumsum(mix(h + _ONE))
        before = s[-1]
        if lo + block >= len(buf):  # the last byte ends the text anyway
            h, s = h[:-1], s[:-1]
        for k in range(64):
            keep = h & np.uint64((1 << k) - 1) == 0
            h, s = h[keep], s[keep]
            if not len(h):
                break
            add(k, s)
    for k in range(len(chunks)):
        add(k, np.array([before]))
    level = next(k for k, c in enumerate(chunks) if len(c) <= CHUNKS)
    return f"{level}:{':'.join(_letters(c) for c in chunks[level : level + LEVELS])}"


def fingerprints(buf: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> list[str]:
    """The fingerprint of each text buf[offsets[i]:offsets[i + 1]]; of an empty text, `0:::`. It depends on the text's bytes alone."""
    lengths = np.diff(offsets)
    long = np.flatnonzero(lengths > block)
    cuts = sorted({0, len(lengths), *long.tolist(), *(long + 1).tolist()})
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = buf[offsets[a] : offsets[b]]
        out += [_long(part, block)] if lengths[a] > block else _short(part, offsets[a : b + 1] - offsets[a])
    return out


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): a row a signature, filled up with -1."""
    digits = _DIGIT[np.frombuffer("".join(signatures).encode(), np.uint8)].reshape(-1, 2)
    lengths = np.array([len(s) // 2 for s in signatures], np.int64)
    out = np.full((len(signatures), CHUNKS), -1)
    out[np.arange(CHUNKS) < lengths[:, None]] = digits[:, 0] * 64 + digits[:, 1]
    return out, lengths


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """How alike the fingerprints of each pair are, from 0 to 1: 1 - d / (m + n), at the lowest level that both have.

    d is the edit distance, in insertions and deletions, of two signatures of m and n chunks. Equal fingerprints, empty ones
    too, are 1, those without a common level 0. All pairs' distances are found at once, a chunk a step, with one 64-bit
    word a pair (a longest common subsequence in bits).
    """
    left, right, at = [], [], []
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        (k, *own), (j, *other) = x.split(":"), y.split(":")
        common = max(int(k), int(j))
        if x != y and common - min(int(k), int(j)) < LEVELS:
            left.append(own[common - int(k)])
            right.append(other[common - int(j)])
            at.append(i)
    if at:
        (p, m), (q, n) = _codes(left), _codes(right)
        state = np.full(len(at), ~np.uint64(0))
        for j in range(int(n.max())):
            match = np.packbits((p == q[:, j : j + 1]) & (q[:, j : j + 1] >= 0), axis=1, bitorder="little").view("<u8").ravel()
            taken = state & match
            state = (state + taken) | (state - taken)
        out[at] = 2 * np.bitwise_count(~state) / np.maximum(m + n, 1)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of their texts' fingerprints; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprints(buf, offsets))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit("")).schema)


def likeness_of(a: Column, b: Column) -> Column:
    """likeness() of two columns of fingerprints, none of them null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(likeness(x.tolist(), y.tolist()))

    return F.pandas_udf(run, DoubleType())(a, b)


def _head(text: bytes, n: int) -> bytes:
    """The first n code points."""
    starts = np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    return text if n >= len(starts) else text[: starts[n]]


def _compared(ids: list, texts: list[bytes], prints: list[str], following: list[bytes], next_prints: list[str]) -> list[pa.Array]:
    """SUMMARY's columns of texts and what follows each."""
    sizes = [int((np.frombuffer(t, np.uint8) & 0xC0 != 0x80).sum()) for t in texts]
    edited = [_head(t, n - n // 2) + _head(f, n // 2) for t, f, n in zip(texts, following, sizes, strict=True)]
    other = fingerprints(np.frombuffer(b"".join(edited), np.uint8), np.cumsum([0, *map(len, edited)]))
    shas = [hashlib.sha256(t).hexdigest() for t in edited]
    return [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(prints), pa.array(other), pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints))]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def half_edits(docs: DataFrame) -> DataFrame:
    """SUMMARY: each text's fingerprint, that of the text with its last half replaced by the next one's start, and likenesses.

    The next document is that of the next smaller id, and the first of all follows the last. Rows of one id come in the
    order of their texts' SHA-256, those without an id after all others; null texts are empty; a single row follows
    itself. Repeated rows are interchangeable, so they may be dealt to different tasks, whatever their number.

    The texts are sorted by ranges of ids, once. A task compares neighbours as they pass and keeps its first and its last
    row, which a join over the ranges (two rows each) then pairs.
    """
    key = [F.desc_nulls_last("doc_id"), F.col("sha"), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    schema = f"{SUMMARY}, {_EDGE}"
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.binary()]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = uuid.uuid4().hex
        last = None

        def edge(kind, row):
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            empty[2] = pa.array([row[4]])
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *empty, *[pa.array([x], t) for x, t in zip((kind, segment, row[1], row[2], row[3]), kinds, strict=True)]], names=_names(schema))

        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                whole = buf.tobytes()
                texts = [whole[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                found = list(zip(part.column("doc_id").to_pylist(), part.column("sha").to_pylist(), part.column("row").to_pylist(), texts, fingerprints(buf, offsets), strict=True))
                if last is None:
                    yield edge("head", found[0])
                else:
                    found.insert(0, last)
                last = found[-1]
                if len(found) > 1:
                    ids, _, _, texts, prints = zip(*found, strict=True)
                    done = _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
                    yield pa.RecordBatch.from_arrays([*done, *[pa.nulls(len(ids) - 1, t) for t in kinds]], names=_names(schema))
        if last is not None:
            yield edge("tail", last)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, own, following, other = (c[0] for c in batch.slice(k, 1).to_pydict().values())
                yield pa.RecordBatch.from_arrays(_compared([doc_id], [text], [own], [following], [other]), names=_names(SUMMARY))

    told = materialize(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(neighbours, schema), "fingerprints")
    heads = told.filter("edge = 'head'").select("segment", "doc_id", "sha", "row").collect()  # one row a task
    order = [h["segment"] for h in sorted(heads, key=lambda h: (h["doc_id"] is None, -(h["doc_id"] or 0), bytes(h["sha"]), h["row"]))]
    done = told.filter("edge is null").select(_names(SUMMARY))
    if not order:
        return done
    links = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "segment string, following string")
    tails = told.filter("edge = 'tail'").select("segment", "doc_id", F.col("text").alias("own_text"), F.col("fingerprint").alias("own"))
    firsts = told.filter("edge = 'head'").select(F.col("segment").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("other"))
    pairs = tails.join(F.broadcast(links), "segment").join(firsts, "following").select("doc_id", "own_text", "own", "next_text", "other")
    return done.unionByName(pairs.mapInArrow(paired, SUMMARY))

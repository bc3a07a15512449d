"""Texts as flat numpy arrays: bytes, words and their hashes, without a Python loop over words.

All hashes are 64 bits and depend on the bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: \x20 and \x09-\x0D part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 1 << 20:  # those of longer texts go with the text
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which span_hash() gets the hash of any byte span of buf."""
    values = (_BYTE_LOWER if lower else _BYTE)[buf]
    values *= _power(_R, len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    h = sums[end] - sums[start]
    h *= _power(_R_INV, len(sums))[start]
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def release() -> None:
    """Give freed memory back to the machine: a worker that waits for its next task shouldn't hold what the last one needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts take about most_bytes (one longer text is a slice of its own).

    Yields (slice, bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null counts as empty.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    if not len(texts):
        return
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // most_bytes
    alone = lengths >= most_bytes
    cuts = [0, *(np.flatnonzero((np.diff(group) > 0) | alone[1:] | alone[:-1]) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi == lo:
            continue
        part = texts.slice(lo, hi - lo)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
        data = part.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield batch.slice(lo, hi - lo), buf, offsets - offsets[0]
        del part, data, buf
    del texts
    release()


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all texts in order; words of text i are first[i]:first[i + 1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(buf)]
    begins[edge] |= inside[edge]
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    back = edge[edge > 0]
    ends[back] |= inside[back - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def repeat_of(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. (length[0] of them), then start[1], ..: indexes of concatenated spans."""
    if not len(length):
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the hash of each run of `size` words; a text with fewer words, but one at least, has its whole sequence."""
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    at = ragged(first[:-1], count)
    h = np.zeros(len(at), np.uint64)
    last = np.repeat(first[1:], count)
    for k in range(size):
        ok = at + k < last
        h = h * np.uint64(0xC2B2AE3D27D4EB4F)
        h[ok] += words[at[ok] + k]
        h ^= h >> np.uint64(29)
    return mix(h), np.concatenate([[0], np.cumsum(count)])

"""Fingerprints against a second, plain writing, and neighbours against a sorted list."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fuzzyhash
from tests.llm.test_operators import SCHEMA, TEXTS, prose

M = 2**64 - 1


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M
    return h ^ h >> 31


BYTE = [mix(b * 0x9E3779B97F4A7C15 & M) for b in range(1, 257)]


def plain(data):
    """A text's fingerprint, chunk by chunk."""
    h = [mix(sum(BYTE[data[i - j]] * 0xD6E8FEB86659FD93**j for j in range(min(7, i + 1))) & M) for i in range(len(data))]

    def chunks(k):
        out, total = [], 0
        for i, x in enumerate(h):
            total += mix(x + 1 & M)
            if i + 1 == len(h) or k < 64 and x % 2**k == 0:
                out.append(mix(total & M) >> 52)
                total = 0
        return out

    level = next(k for k in range(65) if len(chunks(k)) <= 64)
    digit = lambda c: chr(fuzzyhash.ALPHABET[c >> 6]) + chr(fuzzyhash.ALPHABET[c & 63])
    return ":".join([str(level), *("".join(map(digit, chunks(k))) for k in range(level, level + 3))])


def distance(a, b):
    """Insertions and deletions from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def alike(x, y):
    if x == y:
        return 1.0
    (k, *a), (j, *b) = x.split(":"), y.split(":")
    k, j = int(k), int(j)
    if abs(k - j) > 2:
        return 0.0
    pairs = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    a, b = pairs(a[max(k, j) - k]), pairs(b[max(k, j) - j])
    return 1 - distance(a, b) / (len(a) + len(b))


def odd_texts():
    rng = random.Random(2)
    vocabulary = [b"ab", b" ", b"the ", b"\xc3\xa9", b"aaaa", b"\n"]
    return [b"", b"a", b"ab", b"a" * 500, b"Des. " * 90, *(b"".join(rng.choices(vocabulary[: rng.randrange(1, 7)], k=rng.choice([1, 3, 20, 60, 300, 1500]))) for _ in range(40))]


@pytest.mark.parametrize("block", [1 << 20, 50, 333])
def test_fingerprints(block):
    texts = odd_texts()
    got = fuzzyhash.fingerprints(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), block)
    assert got == [plain(t) for t in texts]


def test_likeness():
    prints = [plain(t) for t in odd_texts()] + ["0:::"]
    pairs = [(a, b) for a in prints for b in prints]
    got = fuzzyhash.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [alike(*p) for p in pairs])
    text = prose(1, 2000).encode()
    near = [plain(text), plain(text[:3000] + b"some more words" + text[3000:]), plain(prose(2, 2000).encode())]
    close, far = fuzzyhash.likeness([near[0]] * 2, near[1:])
    assert close > 0.9 and far < 0.1


def brute(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).digest())
    rows = [(r[0], r[1] or "") for r in sorted(rows, key=key)]
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        own, other, after = (fuzzyhash.fingerprints(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0] for x in (t, edited, f))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, other, round(alike(own, other), 9), round(alike(own, after), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_half_edits(spark, parts):
    rows = [(i * 7 % 23, t, "en", "s", 1, "k", 7) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (rows[4][0], "another text of one id", "en", "s", 1, "k", 7), (None, "no id", "en", "s", 1, "k", 7), (None, None, "en", "s", 1, "k", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = fuzzyhash.half_edits(docs).collect()
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr) == brute(rows)


def test_one_hot_id_and_a_long_text(spark):
    rows = [(5, prose(1, 40), "en", "s", 1, "k", 7)] * 200 + [(i, prose(i, 30), "en", "s", 1, "k", 7) for i in range(20)] + [(9, prose(3, 400_000), "en", "s", 1, "k", 7)]
    got = fuzzyhash.half_edits(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=repr) == brute(rows)


def test_small_tables_and_columns(spark):
    assert fuzzyhash.half_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fuzzyhash.half_edits(spark.createDataFrame([(3, "abcdef", "en", "s", 1, "k", 7)], SCHEMA)).collect()
    assert [tuple(r)[:3] for r in one] == [(3, 6, hashlib.sha256(b"abcabc").hexdigest())] and one[0]["near_next"] == 1
    docs = fuzzyhash.with_fingerprints(spark.createDataFrame([(1, "same text", "en", "s", 1, "k", 7), (2, "same text", "en", "s", 1, "k", 7), (3, None, "en", "s", 1, "k", 7)], SCHEMA))
    got = docs.withColumn("alike", fuzzyhash.likeness_of(F.col("fingerprint"), F.lit(plain(b"same text")))).orderBy("doc_id").collect()
    assert [r["alike"] for r in got] == [1.0, 1.0, 0.0] and got[2]["fingerprint"] == "0:::"

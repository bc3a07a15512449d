"""Codes, errors and codebooks against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, n long"


def sample(n, width, seed):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = []
    for i in range(n):
        v = [f32(rng.choice([rng.gauss(0, 0.2), rng.randrange(-2, 3) / 1024, -1e-5])) for _ in range(width)]
        if i % 17 == 3:
            v[rng.randrange(width)] = rng.choice([None, float("nan"), float("inf"), float("-inf")])
        if i % 19 == 5:
            v = None
        if i % 23 == 7:
            v = v and v[: width // 2]
        rows.append((rng.choice([None, 5 * i, 5 * i, 5 * i]), v, rng.choice([None, 0, 1, 2]), "c", 1))
    return rows + rows[:6]


def brute(rows, rounds=4, most=256):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    size = width // 4
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(4)]
    books = [[cut(first[i])[p] for i in sorted(first)[:most]] for p in range(4)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [near(cut(v)[p], books[p]) for p in range(4)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return sorted(((i, c, e, sum(x[2] for x in coded if x[3] == label), sha) for i, c, e, label in coded), key=repr)


@pytest.mark.parametrize(("n", "width", "labels"), [(330, 8, 4096), (30, 6, 2)])
def test_against_integers(spark, monkeypatch, n, width, labels):
    monkeypatch.setattr(vectorcodes, "LABELS", labels)
    rows = sample(n, width, n)
    got = vectorcodes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_nearest_is_the_first_of_equals():
    rng = np.random.default_rng(3)
    entries = rng.integers(-3, 4, (40, 4))
    rows = rng.integers(-(2**20), 2**20, (50, 4))
    rows[:20] = entries[:20]
    best, d = vectorcodes.nearest(rows, entries)
    for r, b, x in zip(rows, best, d, strict=True):
        every = [int(((r - e) ** 2).sum()) for e in entries]
        assert x == min(every) and b == every.index(x)


def test_integers_of_sliced_columns():
    column = pa.array([[1.0], None, [0.5, None], [], [-0.0001, 2.0]], pa.list_(pa.float32()))
    rows, lengths, values = vectorcodes.integers(column.slice(1))
    assert rows.tolist() == [2, 3] and lengths.tolist() == [0, 2] and values.tolist() == [-1, 2048]


def test_edges(spark):
    assert vectorcodes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], 1, "c", 1)], SCHEMA)
    assert [tuple(r)[:4] for r in vectorcodes.compress(nameless).collect()] == [(None, None, None, None)]
    nothing = spark.createDataFrame([(1, [], None, "c", 1), (2, None, 1, "c", 1)], SCHEMA)
    assert [tuple(r)[:4] for r in vectorcodes.compress(nothing).collect()] == [(1, "00000000", 0, 0)]
    huge = spark.createDataFrame([(1, [1e30] * 4, 1, "c", 1)], SCHEMA)
    with pytest.raises(ArithmeticError, match="64 bits"):
        vectorcodes.compress(huge)

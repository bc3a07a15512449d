"""The audit against running every order of the filters, one document at a time."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from ledgerline.llm import filteraudit
from tests.llm.test_operators import SCHEMA


def sample(n):
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "EFG", "h", "ünd", "x|y", "日本", "z"]
    texts = [None, "", " \t\n", "A", "É", "a " * 199, "a " * 200, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)) + " #", "\x0b".join(f"W{i}" for i in range(400)), "w\x85v u " * 300]
    texts += [" ".join(rng.choices(vocabulary[: rng.randrange(1, 9)], k=rng.randrange(0, 400))) for _ in range(40)]
    rows = [(rng.choice([None, i, i, i, i]), rng.choice(texts), rng.choice([None, "", "en", "de"]), "s", 1, "k", 7) for i in range(n)]
    labels = [(rng.choice([None, rng.randrange(n)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), 3) for _ in range(n)]
    return [*rows, *rows[:9]], labels


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = {r[0] for r in labels if r[1] == 1} - {None}, {r[0] for r in labels if r[2] == 1} - {None}
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = words(t)
        fails = {x for x, f in zip("ABCDE", [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t]]) if f}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("n", [1, 150])
def test_every_order(spark, n):
    rows, labels = sample(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, mask int"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, labels).count() == 0
    rows, _ = sample(20)
    got = filteraudit.audit(spark.createDataFrame(rows, SCHEMA), labels)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [])


def test_a_long_text(spark):
    text = "word " * 1_000_000 + "A|" * 10
    got = filteraudit.failure_masks(spark.createDataFrame([(1, text, "en", "s", 1, "k", 7)], SCHEMA)).first()
    assert got["mask"] == 0b1010

"""Language identification by interpolated Kneser-Ney character models.

One model a language, of order ORDER, trained on a bounded sample of labelled rows (`per_language` rows;
nothing else is sampled). Counts live in sorted arrays of 64-bit n-gram hashes. A text goes to the language
with the lowest cross-entropy a character; how sure that is comes from a logistic curve over the margin to
the runner-up and the length, fitted on sample rows that the models didn't see. Rows under `accept` are
marked rejected.

Texts that are null or have no letter get `und` and score 0. Ties go to the first language by name. Rows
with a null id or language don't train. Repeated rows predict alike. If nothing can be learned, all
predictions are `und`. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.textarrays import mix, text_slices
from ledgerline.llm.toxicity import held_out

ORDER = 4
DISCOUNT = 0.75
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@functools.lru_cache(1)
def folded() -> np.ndarray:
    """Each code point's lower-case letter; 32 for what isn't a letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def characters(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first) of joined texts of the given lengths: letters folded, each run of others one space, a space before each text."""
    codes = folded()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    at = np.cumsum(lengths) - lengths
    codes = np.insert(codes, at, 32)
    first = np.concatenate([at + np.arange(len(lengths)), [len(codes)]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    keep[first[:-1]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def grams(codes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For n = 0 .. ORDER: the hash of the n characters that end at each position (spaces before the text's start)."""
    pos = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
    h, out = np.full(len(codes), 1, np.uint64), []
    out.append(h.copy())
    for k in range(ORDER):
        back = np.full(len(codes), 32, np.uint64)
        back[k:] = codes[: len(codes) - k]
        back[pos < k] = 32
        h = h + mix(back + np.uint64(k * 0x200000)) * _MULT[k]
        out.append(mix(h))
    return out


@dataclass(frozen=True)
class KneserNey:
    """keys[n], p[n]: seen n-grams (sorted hashes) and their interpolated probability; contexts[n], back[n]: what a seen context of n characters leaves to the shorter one."""

    keys: tuple[np.ndarray, ...]
    p: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    back: tuple[np.ndarray, ...]
    floor: float

    def prob(self, full: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """full[n]: hashes of n-grams ending at a character; context[n]: of the n characters before it."""
        out = np.full(len(full[1]), self.floor)
        for n in range(1, ORDER + 1):
            at, seen = _find(self.contexts[n - 1], context[n - 1])
            out *= np.where(seen, self.back[n - 1][at], 1.0)
            at, seen = _find(self.keys[n], full[n])
            out = np.where(seen, self.p[n][at], out)
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def contexts_of(h: list[np.ndarray], first: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
    """contexts of n characters before each position: the n-gram that ends one earlier."""
    start = grams(np.array([32], np.uint32), np.array([0, 1]))  # what ends just before a text: spaces
    out = []
    for n in range(ORDER):
        c = np.empty_like(h[n])
        c[1:] = h[n][:-1]
        c[first[:-1][np.diff(first) > 0]] = start[n][0]
        out.append(c)
    return out


def train(texts: list[str]) -> KneserNey:
    lengths = np.array([len(t) for t in texts], np.int64)
    codes, first = characters("".join(texts), lengths)
    full = grams(codes, first)
    context = contexts_of(full, first, codes)
    symbols = len(np.unique(codes)) + 1
    keys, p, ctx, back = [np.zeros(0, np.uint64)], [np.zeros(0)], [], []
    uniq, where, count = np.unique(full[ORDER], return_index=True, return_counts=True)
    levels = {ORDER: (uniq, where, count)}
    for n in range(ORDER - 1, 0, -1):  # below the top an n-gram counts once for each longer one that it ends
        _, at, _ = levels[n + 1]
        u, w, c = np.unique(full[n][at], return_index=True, return_counts=True)
        levels[n] = (u, at[w], c)
    lower = None
    for n in range(1, ORDER + 1):
        u, w, c = levels[n]
        own, of = np.unique(context[n - 1][w], return_inverse=True)
        total, kinds = np.bincount(of, c), np.bincount(of)
        leave = DISCOUNT * kinds / total
        if lower is None:
            below = np.full(len(u), 1 / symbols)
        else:
            at, _ = _find(keys[n - 1], full[n - 1][w])
            below = lower[at]
        lower = np.maximum(c - DISCOUNT, 0) / total[of] + leave[of] * below
        keys.append(u)
        p.append(lower)
        ctx.append(own)
        back.append(leave)
    return KneserNey(tuple(keys), tuple(p), tuple(ctx), tuple(back), 1 / symbols)


@dataclass(frozen=True)
class Identifier:
    languages: tuple[str, ...]
    models: tuple[KneserNey, ...]
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)
    accept: float = 0.5

    def entropies(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character [texts, languages], characters)."""
        codes, first = characters(text, lengths)
        full = grams(codes, first)
        context = contexts_of(full, first, codes)
        _, where, of = np.unique(full[ORDER], return_index=True, return_inverse=True)
        n = np.diff(first)
        letters = np.bincount(np.repeat(np.arange(len(n)), n), codes != 32, len(n))
        out = np.zeros((len(n), len(self.models)))
        f, c = [h[where] for h in full], [h[where] for h in context]
        for k, model in enumerate(self.models):
            bits = -np.log2(model.prob(f, c))[of]
            out[:, k] = np.add.reduceat(bits, first[:-1]) / n if len(bits) else 0
        return out, letters

    def predict(self, text: str, lengths: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.models:
            return ["und"] * len(lengths), np.zeros(len(lengths)), np.zeros(len(lengths))
        bits, letters = self.entropies(text, lengths)
        best = bits.argmin(1)
        own = bits[np.arange(len(best)), best]
        score = np.where(letters > 0, self.sure(bits, letters), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score, own

    def sure(self, bits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        if bits.shape[1] < 2:
            return np.ones(len(bits))
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + _features(bits, letters) @ np.array([b, c]), -40, 40)))


def _features(bits: np.ndarray, letters: np.ndarray) -> np.ndarray:
    two = np.partition(bits, 1, axis=1)[:, :2]
    margin = two[:, 1] - two[:, 0]
    return np.stack([margin, margin * np.sqrt(np.minimum(letters, 400))], 1)


def calibrate(model: Identifier, texts: list[str], truth: list[str], wanted: float = 0.99) -> Identifier:
    """Fit the curve on rows the models didn't see, and accept where nine in ten of the wanted precision is reached."""
    if len(model.models) < 2 or not texts:
        return model
    bits, letters = model.entropies("".join(texts), np.array([len(t) for t in texts]))
    right = np.array([model.languages[b] == t for b, t in zip(bits.argmin(1), truth, strict=True)], float)
    x = np.column_stack([np.ones(len(texts)), _features(bits, letters)])
    w = np.zeros(3)
    for _ in range(30):  # Newton, with a small ridge for separable data
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (p - right) + 0.1 * w)
    w = np.array([w[0], max(w[1], 0), max(w[2], 0)])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    order = np.argsort(-p)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(p) + 1) >= wanted)
    return Identifier(model.languages, model.models, tuple(w.tolist()), float(p[order][good[-1]]) if len(good) else 1.0)


def fit(docs: DataFrame, per_language: int = 1500, most_chars: int = 10_000, folds: int = 5) -> Identifier:
    """Train on per_language rows a language outside the held-out fold, one in six of them for calibration."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds) & (F.length("text") <= most_chars))
    ids, languages = None, [r["lang"] for r in own.select("lang").distinct().orderBy("lang").collect()]
    for lang in languages:
        part = own.filter(F.col("lang") == lang).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_language)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return Identifier((), ())
    rows = own.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    seen = [r for i, r in enumerate(rows) if i % 6]
    kept = [r for i, r in enumerate(rows) if not i % 6]
    languages = [x for x in languages if any(r["lang"] == x for r in seen)]
    model = Identifier(tuple(languages), tuple(train([r["text"] for r in seen if r["lang"] == x]) for x in languages))
    return calibrate(model, [r["text"] for r in kept], [r["lang"] for r in kept])


def identify(docs: DataFrame, model: Identifier, folds: int = 5) -> DataFrame:
    """PREDICTIONS for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, _ in text_slices(batch, "text"):
                lengths = pc.fill_null(pc.utf8_length(part.column(2)), 0).to_numpy().astype(np.int64)
                langs, score, bits = shared.value.predict(buf.tobytes().decode(), lengths)
                und = np.array([x == "und" for x in langs])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(score), pa.array(bits, mask=und), pa.array(und | (score < shared.value.accept))], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), held_out(own, folds).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTIONS)

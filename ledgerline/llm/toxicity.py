"""Toxicity scores: averaged subword-bag embeddings under a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (and of itself), hashed into a fixed
number of buckets, so an unseen misspelling shares most of its vector with the word it comes from. A window of
WINDOW words is the mean of its words, and a document scores as its highest window, so that a few words count
in a long text too; the more windows, the higher the score that it takes (`length`, fitted). Embeddings and
softmax are trained jointly, in numpy, on windows of a bounded sample of labelled rows (`per_class` of each
label, of `most_chars` characters at most; nothing else is sampled): of whole texts first, then in ROUNDS of
each text's highest window and a share of the clean ones. Buckets of fewer than LEAST texts don't train: they
would only tell texts apart. A fifth of the sample, from which the embeddings don't learn, places the
threshold. The softmax is linear, so a trained model is one number a bucket: 512 KiB whatever the corpus,
which is what goes to the tasks.

Null and empty texts, and texts without letters, say nothing: their score is the share of label 1. Rows with a null id or
label don't train; of several labels of an id the larger counts, of its texts the smallest. Repeated rows score
alike. Without any usable label all scores are 0. An empty table gives an empty result. Other columns are ignored by
`score` and kept by `clean_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.textarrays import prefix_hash, ragged, release, span_hash, text_slices, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
WINDOW, STRIDE, LEAST, ROUNDS = 4, 2, 4, 3
#: Windows of clean texts that a round trains on beside each text's highest.
CLEAN_WINDOWS = 8000
SCORES = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Subwords:
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    buckets: int = 1 << 16

    def bags(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry buckets, entry words, words, first, keys): subwords of the distinct words; words of text i, by number, are words[first[i]:first[i + 1]]."""
        n = len(offsets) - 1
        # every text gets a space before it and one after the last; all but letters become spaces
        clean = np.full(len(buf) + n + 1, 32, np.uint8)
        at = np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
        low = buf.copy()
        low[(buf >= 65) & (buf <= 90)] += 32
        accent = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[:-1] == 0xC3)) + 1
        low[accent] += 32
        low[~_LETTER[buf]] = 32
        clean[at] = low
        start, end, first = word_spans(clean, np.r_[offsets[:-1] + np.arange(n), len(clean)])
        sums = prefix_hash(clean)
        keys, where, words = np.unique(span_hash(sums, start, end), return_index=True, return_inverse=True)
        start, end = start[where] - 1, end[where] + 1  # with the marks around it
        own = np.arange(len(start))
        entries, of = [span_hash(sums, start, end)], [own]
        for size in self.sizes:
            count = np.maximum(end - start - size + 1, 0)
            count[end - start == size] = 0  # the whole is there already
            s = ragged(start, count)
            entries.append(span_hash(sums, s, s + size))
            of.append(np.repeat(own, count))
        return (np.concatenate(entries) % np.uint64(self.buckets)).astype(np.int32), np.concatenate(of).astype(np.int32), words, first, keys

    def of_texts(self, texts: list[str], slice_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(entry buckets, entry words, words of all texts in order, first): distinct words are numbered over all texts, a slice at a time."""
        seen, bucket, of, word, sizes = np.zeros(0, np.uint64), [], [], [], []
        number = np.zeros(0, np.int64)
        done = n_words = 0
        while done < len(texts):
            raw, size = [], 0
            while done + len(raw) < len(texts) and (not raw or size < slice_bytes):
                raw.append((texts[done + len(raw)] or "").encode())
                size += len(raw[-1])
            b, o, words, first, keys = self.bags(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            at = np.minimum(np.searchsorted(seen, keys), max(len(seen) - 1, 0))
            new = seen[at] != keys if len(seen) else np.ones(len(keys), bool)
            own = np.where(new, n_words + np.cumsum(new) - 1, number[at] if len(seen) else 0)
            keep = new[o]
            bucket.append(b[keep])
            of.append(own[o[keep]].astype(np.int32))
            word.append(own[words].astype(np.int32))
            sizes.append(np.diff(first))
            seen, number = np.concatenate([seen, keys[new]]), np.concatenate([number, own[new]])
            order = np.argsort(seen)
            seen, number, n_words, done = seen[order], number[order], n_words + int(new.sum()), done + len(raw)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return cat(bucket, np.int32), cat(of, np.int32), cat(word, np.int32), np.concatenate([[0], np.cumsum(cat(sizes, np.int64))])


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of WINDOW words each, every STRIDE; a shorter text is one window, one without words none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return start, np.minimum(start + WINDOW, first[text + 1]), text


def highest(word_scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' means, each text's highest, each text's number of windows) from the scores of all words in order."""
    start, end, text = windows(first)
    sums = np.concatenate([[0.0], np.cumsum(word_scores)])
    means = (sums[end] - sums[start]) / np.maximum(end - start, 1)
    best = np.full(len(first) - 1, -np.inf)
    np.maximum.at(best, text, means)
    return means, best, np.bincount(text, minlength=len(first) - 1)


@dataclass(frozen=True)
class Model:
    subwords: Subwords
    weight: np.ndarray  # a bucket's vector times the softmax's difference
    bias: float
    prior: float = 0.0  # the score of a text without words
    length: float = 0.0  # what each doubling (base e) of the number of windows adds

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z, n = self.logits(buf, offsets)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.prior)

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds, windows) of each text."""
        bucket, of, words, first, _ = self.subwords.bags(buf, offsets)
        if not len(words):
            return np.full(len(offsets) - 1, self.bias), np.zeros(len(offsets) - 1, np.int64)
        word = np.bincount(of, self.weight[bucket]) / np.bincount(of)
        _, best, n = highest(word[words], first)
        return np.where(n > 0, best, 0.0) + self.bias + self.length * np.log(np.maximum(n, 1)), n


def train(texts: list[str], labels: np.ndarray, prior: float, subwords: Subwords = Subwords(), dim: int = 8, epochs: int = 100, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Full-batch Adam on log-loss, both labels with equal weight. prior: the share of label 1 in the table.

    As all is linear up to the softmax, a step needs the embeddings' products with the softmax's difference only,
    forwards and backwards: one number a bucket, word and bag. A bag is a whole text at first, then a window.
    """
    bucket, of, words, first = subwords.of_texts(texts)
    n_words = int(of.max(initial=-1)) + 1
    parts = 1 / np.maximum(np.bincount(of, minlength=n_words), 1)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pairs = np.unique(text * max(n_words, 1) + words)  # a text's distinct words
    of_word = np.bincount(pairs % max(n_words, 1), minlength=n_words)
    trained = np.zeros(subwords.buckets, np.int32)
    for a in range(0, len(of), 1 << 19):
        trained += np.bincount(bucket[a : a + (1 << 19)], of_word[of[a : a + (1 << 19)]], subwords.buckets).astype(np.int32)
    trained = trained >= LEAST
    keep = trained[bucket]  # the others' vectors are zero
    bucket, of = bucket[keep], of[keep]
    of_text, of_pair = (pairs // max(n_words, 1)).astype(np.int32), (pairs % max(n_words, 1)).astype(np.int32)
    del text, pairs, keep

    def fit_bags(bag: np.ndarray, word: np.ndarray, y: np.ndarray, gain: float) -> tuple[np.ndarray, float]:
        """(weight of each bucket, bias) of bags y, whose words are the pairs (bag, word); gain: a mean over many words is small."""
        n = len(y)
        share = (1 / np.maximum(np.bincount(bag, minlength=n), 1)).astype(np.float32)
        rng = np.random.default_rng(7)
        e = rng.normal(0, 0.05, (dim, subwords.buckets)) * trained
        w = rng.normal(0, 0.5, dim)
        weights = 1 / np.maximum(np.bincount(y.astype(int), minlength=2), 1)[y.astype(int)]
        weights = weights / weights.sum()
        bias = np.zeros(1)
        values = (e, w, bias)
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in values]
        for step in range(1, epochs + 1):
            u = np.bincount(of, (w @ e)[bucket], n_words) * parts
            p = 1 / (1 + np.exp(-np.clip(gain * share * np.bincount(bag, u[word], n) + bias, -40, 40)))
            g = weights * (p - y)
            gu = gain * np.bincount(word, (share * g)[bag], n_words) * parts
            ge = np.bincount(bucket, gu[of], subwords.buckets) * trained
            for (m, s), grad, x in zip(state, (np.outer(w, ge) + decay * e, e @ ge, g.sum(keepdims=True)), values, strict=True):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return gain * (w @ e), float(bias[0])

    weight, bias = fit_bags(of_text, of_pair, labels, 30.0)
    del of_text, of_pair
    start, end, own = windows(first)
    for turn in range(ROUNDS if len(start) else 0):
        means, best, _ = highest((np.bincount(of, weight[bucket], n_words) * parts)[words], first)
        clean = labels[own] == 0
        chosen = np.flatnonzero((means >= best[own]) | clean & (np.random.default_rng(turn).random(len(own)) < min(0.1, CLEAN_WINDOWS / max(1, clean.sum()))))
        size = end[chosen] - start[chosen]
        weight, bias = fit_bags(np.repeat(np.arange(len(chosen)), size), words[ragged(start[chosen], size)], labels[own[chosen]], 3.0)
    return Model(subwords, weight, bias, prior)


def logits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, windows) of each text."""
    out = [(np.zeros(0), np.zeros(0, np.int64))]
    for lo in range(0, len(texts), 32):  # bounds the memory
        raw = [t.encode() for t in texts[lo : lo + 32]]
        out.append(model.logits(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    return np.concatenate([z for z, _ in out]), np.concatenate([n for _, n in out])


def calibrate(model: Model, x: np.ndarray, windows_of: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Model:
    """Slope, length and bias fitted to logits of rows that the model didn't learn from, so that 0.5 is where either label is as likely in the table."""
    if not 0 < y.sum() < len(y):
        return model
    weights = weights / weights.sum() * len(y)
    a = np.array([0.0, 1.0, 0.0])
    design = np.column_stack([np.ones(len(x)), x, np.log(np.maximum(windows_of, 1))])
    firm, at = np.array([0.01, 1.0, 1.0]), np.array([0.0, 1.0, 0.0])

    def loss(a: np.ndarray) -> float:
        z = design @ a
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (firm * (a - at) ** 2).sum())

    for _ in range(50):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(design @ a, -40, 40)))
        grad = design.T @ (weights * (p - y)) + firm * (a - at)
        step = np.linalg.solve((design * (weights * p * (1 - p))[:, None]).T @ design + np.diag(firm), grad)
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
    return replace(model, weight=model.weight * max(a[1], 0), bias=float(a[0] + a[1] * model.bias), length=float(min(a[2], 0)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int = 5, most_chars: int = 20_000):
    """(doc_id, y, text, size) of per_class training rows a label at most, None without any; only ids are ranked, texts are joined after. size: how many rows of the table have the label."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), folds))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in sorted(sizes):
        part = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return None
    size = F.create_map(*[F.lit(x) for y in sizes for x in (y, sizes[y])])[F.col("y")].alias("size")
    return texts.filter(F.length("text") <= most_chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", "text", size)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500, folds: int = 5) -> Model:
    """Trained in one task on the bounded sample; one in five of its rows, of each label, places the threshold, the others train."""
    sample = labelled_sample(docs, labels, label, per_class, folds)
    none = Model(Subwords(), np.zeros(Subwords().buckets), -40.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        if rows:
            y = np.array([r[1] for r in rows], float)
            turn = np.zeros(len(y), int)
            for k in (0, 1):
                turn[y == k] = np.arange((y == k).sum())
            kept = turn % 5 == 4
            weights = np.array([r[3] for r in rows], float) / np.where(y == 1, max(1, y.sum()), max(1, (1 - y).sum()))
            model = train([r[2] for r, own in zip(rows, kept, strict=True) if not own], y[~kept], float((weights * y).sum() / weights.sum()))
            model = calibrate(model, *logits(model, [r[2] for r, own in zip(rows, kept, strict=True) if own]), y[kept], weights[kept])
            yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()]), *(pa.array([x]) for x in (model.bias, model.prior, model.length))], names=["weight", "bias", "prior", "length"])
        release()

    got = sample.repartition(1).mapInArrow(run, "weight binary, bias double, prior double, length double").collect() if sample is not None else []
    return replace(none, weight=np.frombuffer(got[0]["weight"], "<f4").astype(float), bias=got[0]["bias"], prior=got[0]["prior"], length=got[0]["length"]) if got else none


def score(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """SCORES of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                s = shared.value.score(buf, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id"), held_out(own, folds).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(buf, offsets) < threshold))

    return docs.mapInArrow(keep, docs.schema)

"""Marginal document probabilities under a subword unigram lattice.

The pieces are those of an existing subword vocabulary (never trained here). Their probabilities come from
the training documents: every distinct training word is cut by that vocabulary's own encoder, pieces are
counted with the words' counts, and one is added to each count. A word's probability is the sum over all
its segmentations, by the forward recursion in log space; pieces never cross white space, so a document's
log probability is the sum over its words and its end.

Work by size: word counts are one shuffle of (word, count) with partial sums; the lattice runs once a
distinct word. Words are looked up by 64-bit hash: the most frequent ones, HEAD at most, from a sorted
array sent to the tasks (12 MiB, whatever the corpus); all others by a join.

Null and empty texts, and texts of white space, have one token, their end. A character that the vocabulary
lacks counts as its UTF-8 bytes' pieces. Repeated rows score alike. Other columns are ignored; an empty
table gives an empty result. Rows with a null id are scored and never train.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.storage import discard, materialize
from ledgerline.llm.textarrays import LOWER, prefix_hash, repeat_of, span_hash, text_slices, word_spans

HEAD = 1 << 19
LONGEST = 16
END = "</doc>"
MARK = "▁"


def word_counts(docs: DataFrame, folds: int = 7, out_fold: int = 2) -> DataFrame:
    """(h, word, c): each distinct word of docs, lower-cased A-Z, with its count in the training documents (0 for words of held-out ones only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text", 1 << 21):
                start, end, first = word_spans(buf, offsets)
                h, where, of = np.unique(span_hash(prefix_hash(buf, lower=True), start, end), return_index=True, return_inverse=True)
                trains = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                c = np.bincount(of, trains[repeat_of(first)], len(h)).astype(np.int64)
                raw = LOWER[buf].tobytes()
                words = [raw[s:e] for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(c)], names=["h", "word", "c"])

    found = docs.select("text", "trains").mapInArrow(run, "h long, word string, c long")
    return found.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def piece_counts(words: DataFrame, model_path: str) -> dict[str, int]:
    """Counts of the vocabulary's pieces over the training words: one row a piece at most, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _encoder(model_path)
        total: dict[int, int] = {}
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for ids, c in zip(cut.encode(texts, num_threads=1), counts, strict=True):
                for i in ids:
                    total[i] = total.get(i, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    cut = _encoder(model_path)
    rows = words.filter("c > 0").select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {cut.id_to_piece(r["id"]): r["n"] for r in rows}


def _encoder(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


class Lattice:
    """log10 probabilities of pieces, and of words over all their segmentations."""

    def __init__(self, logp: dict[str, float]):
        self.logp = logp
        self.floor = min(logp.values())

    @classmethod
    def of(cls, model_path: str, counts: dict[str, int], ends: int) -> Lattice:
        cut = _encoder(model_path)
        pieces = [cut.id_to_piece(i) for i in range(cut.get_piece_size()) if not (cut.is_control(i) or cut.is_unknown(i) or cut.is_unused(i))]
        total = sum(counts.values()) + ends + len(pieces) + 1
        return cls({p: math.log10((counts.get(p, 0) + 1) / total) for p in pieces} | {END: math.log10((ends + 1) / total)})

    def end(self) -> float:
        return self.logp[END]

    def word(self, word: str) -> float:
        """Forward recursion: alpha[t] is the log10 probability of all ways to make the first t characters."""
        text = MARK + word
        logp, alpha = self.logp, [0.0]
        for t in range(1, len(text) + 1):
            ways = []
            for s in range(max(0, t - LONGEST), t):
                p = logp.get(text[s:t])
                if p is not None:
                    ways.append(alpha[s] + p)
            c = text[t - 1]
            if c not in logp:  # byte fallback
                ways.append(alpha[t - 1] + sum(logp.get(f"<0x{b:02X}>", self.floor) for b in c.encode()))
            top = max(ways)
            alpha.append(top if len(ways) == 1 else top + math.log10(sum(10 ** (x - top) for x in ways)))
        return alpha[-1]


def score(docs: DataFrame, model_path: str, folds: int = 7, out_fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    own = F.col("doc_id").cast("long")
    out = F.coalesce(F.crc32(own.cast("string").cast("binary")) % folds == out_fold, F.lit(False))
    docs = docs.select(own.alias("doc_id"), out.alias("held_out"), F.col("text").cast("string").alias("text")).withColumn("trains", ~F.col("held_out") & F.col("doc_id").isNotNull())

    words = materialize(word_counts(docs, folds, out_fold), "lm-words")
    totals = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = docs.filter("trains").count()
    n, v = (totals["n"] or 0) + ends, (totals["v"] or 0) + (ends > 0)
    lattice = Lattice.of(model_path, piece_counts(words, model_path), ends)
    shared = spark.sparkContext.broadcast(lattice.logp)
    unit = math.log10(n + (v + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(shared.value)
        for batch in batches:
            c = batch.column(2).to_numpy().astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.log10(c + 1) - unit), pa.array([own.word(w) for w in batch.column(1).to_pylist()], pa.float64())], names=["h", "c", "base", "lattice"])

    known = materialize(words.mapInArrow(weigh, "h long, c long, base double, lattice double"), "lm-lattice")
    discard(words)

    # the head: counts of counts (few rows) tell from which count on HEAD words are enough
    tally = known.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    least, have = 1 << 62, 0
    for r in tally:
        have += r["n"]
        if have > HEAD:
            break
        least = r["c"]
    head = known.filter(F.col("c") >= least).select("h", (F.col("c") > 0).alias("known"), "base", "lattice").toArrow()
    keys = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], *(head.column(x).to_numpy(zero_copy_only=False)[order].astype(np.float64) for x in ("known", "base", "lattice"))))
    end_base, end_lattice, end_known = math.log10(ends + 1) - unit, lattice.end(), int(ends > 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = table.value
        for batch in batches:
            for part, buf, offsets in text_slices(batch, "text"):
                start, end, first = word_spans(buf, offsets)
                h, of = np.unique(span_hash(prefix_hash(buf, lower=True), start, end), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                there = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                doc, size = repeat_of(first), len(offsets) - 1
                sums = [np.bincount(doc, np.where(there, x[at], 0.0)[of], size) if len(keys) else np.zeros(size) for x in values]
                rare = ~there[of]
                lists = np.split(h[of[rare]].view(np.int64), np.cumsum(np.bincount(doc[rare], minlength=size))[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first) + 1), pa.array(sums[0].astype(np.int64) + end_known), pa.array(sums[1] + end_base), pa.array(sums[2] + end_lattice), pa.array(list(lists), pa.list_(pa.int64()))], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "rare"])

    added = docs.select("doc_id", "held_out", "text").mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lattice double, rare array<long>")
    added = materialize(added.withColumn("row", F.monotonically_increasing_id()), "lm-head")
    rest = added.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("tf"))
    rest = rest.join(known.filter(F.col("c") < least), "h").groupBy("row").agg(F.sum(F.col("tf") * (F.col("c") > 0).cast("long")).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"), F.sum(F.col("tf") * F.col("lattice")).alias("l"))
    both = added.drop("rare").join(rest, "row", "left")
    return both.select("doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("lattice") + F.coalesce("l", F.lit(0.0))).alias("score"))

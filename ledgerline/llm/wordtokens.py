"""Token ids of whole texts with a public tokenizer, each distinct piece of text encoded once a worker.

Only cuts at which the tokenizer parts its words anyway are used: at white space, and between an ASCII
letter or digit and ASCII punctuation (not apostrophes, nor the marks that special tokens are made of).
"""

from __future__ import annotations

import functools
import os

import numpy as np

from ledgerline.llm.textarrays import prefix_hash, ragged, span_hash, word_spans

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_CLASS[[ord(c) for c in '.,;:!?*$%&#()"/+=@']] = 2
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123)]] = 1


@functools.lru_cache(2)
def word_tokenizer(tokenizer_path: str, special_as_text: bool = False) -> WordTokenizer:
    """One for each Python worker: what one task has encoded serves the next."""
    return WordTokenizer(tokenizer_path, special_as_text)


class WordTokenizer:
    """tokenizer_path: a `tokenizers` file that lower-cases, drops white space and marks the ends of words by </w>."""

    def __init__(self, tokenizer_path: str, special_as_text: bool = False, most_pieces: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(tokenizer_path)
        self.encoder.encode_special_tokens = special_as_text
        self.most_pieces = most_pieces
        size = self.encoder.get_vocab_size()
        self.ends_word = np.fromiter(((self.encoder.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint16), 0

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of text i are ids[first[i]:first[i + 1]]."""
        if len(self.keys) > self.most_pieces:  # bounds the memory; pieces met again are encoded again
            self.forget()
        start, end, _ = word_spans(buf, offsets)
        kind = _CLASS[buf]
        cut = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] * kind[:-1] == 2)) + 1
        if len(cut):
            inside = np.searchsorted(start, cut, side="right") - 1
            cut = cut[(start[inside] < cut) & (cut < end[inside])]
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        first = np.searchsorted(start, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        own = span_hash(prefix_hash(buf, lower=True), start, end)
        marked = np.concatenate([[0], np.cumsum(buf == ord("<"))])
        marked = np.flatnonzero(marked[end] > marked[start])
        if len(marked):  # may be a special token, which is matched before letters are lowered
            own[marked] = ~span_hash(prefix_hash(buf), start[marked], end[marked])
        hashes, where, back = np.unique(own, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.flatnonzero(at == len(self.keys)) if not len(self.keys) else np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != hashes)
        if len(new):
            self._learn(buf, start[where[new]], end[where[new]], hashes[new])
            at = np.searchsorted(self.keys, hashes)
        starts, lengths = self.starts[at][back], self.lengths[at][back].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ragged(starts, lengths)].astype(np.uint32), before[first]

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        raw = buf.tobytes()
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        plain = letters[end] - letters[start] == end - start
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        texts = [raw[s:e].decode() for s, e in zip(start[order].tolist(), end[order].tolist(), strict=True)]
        # runs of letters are one word each, so many go through in one call and </w> parts them again
        joined = self.encoder.encode_batch_fast([" ".join(texts[i : min(i + 64, n)]) for i in range(0, n, 64)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint16), *(np.array(x.ids, np.uint16) for x in joined)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != n or (n and ends[-1] != len(ids)):
            raise ValueError("the tokenizer doesn't end each run of letters with a word-end token")
        rest = [x.ids for x in self.encoder.encode_batch_fast(texts[n:], add_special_tokens=False)] if n < len(texts) else []
        lengths = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int64)
        ids = np.concatenate([ids, np.fromiter((i for x in rest for i in x), np.uint16)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        keys = np.concatenate([self.keys, keys[order]])
        by = np.argsort(keys)
        self.keys, self.starts = keys[by], np.concatenate([self.starts, starts])[by]
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])[by]

"""Token ids of whole texts by a public vocabulary, each distinct piece of text encoded once.

A text is cut at places where the vocabularies' own splitting patterns always cut: before a space, or around a
line feed, that stands between two characters which are surely not white space, and between an ASCII letter and an
ASCII punctuation mark other than an apostrophe. The pieces' ids, one after
another, are therefore the whole text's ids. Only pieces that a Python worker has not met are given to the
tokenizer; the others are looked up by 64-bit hash in a table of bounded size.
"""

from __future__ import annotations

import os

import numpy as np

from . import kernel as K

_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_NEXT = _GRAPH | _LEAD
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = _GRAPH & ~_LETTER
_MARK[48:58] = _MARK[39] = _MARK[124] = False  # neither digits nor the apostrophe nor the bar of special tokens


class Encoder:
    """`encode(texts)` gives all ids back to back and the number of ids of each text."""

    def __init__(self, path: str, limit: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.begin, self.length = np.zeros(0, K.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def pieces(self, t: K.Texts) -> K.Spans:
        n, data = t.size, t.data
        cut = np.zeros(n + 1, bool)
        cut[t.starts[t.starts < t.ends]] = True
        if n > 2:
            before = _GRAPH[data[: n - 1]]
            before[1:] |= (data[1 : n - 1] & 0xC0 == 0x80) & _LEAD[data[: n - 2]]
            between = before[: n - 2] & _NEXT[data[2:n]]  # of the byte at 1, 2, ... n - 2
            space, line = between & (data[1 : n - 1] == 32), between & (data[1 : n - 1] == 10)
            cut[1 : n - 1] |= space | line
            cut[2:n] |= line
            cut[1:n] |= _LETTER[data[: n - 1]] & _MARK[data[1:n]]
        start = np.flatnonzero(cut[:n])
        end = np.append(start[1:], n) if len(start) else start
        first = np.searchsorted(start, np.append(t.starts, n))
        return K.Spans(start, end, first, np.repeat(np.arange(len(t.starts)), np.diff(first)))

    def encode(self, t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        p = self.pieces(t)
        keys, at, inverse = K.distinct(K.span_hash(t.data, p.start, p.end))
        place = self._learn(t, keys, p.start[at], p.end[at])
        length = self.length[place][inverse]
        ids = self.ids[K.ranges(self.begin[place][inverse], length)]
        total = np.append(0, np.cumsum(length))
        return ids, total[p.first[1:]] - total[p.first[:-1]]

    def _learn(self, t: K.Texts, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(keys) > max(self.limit, len(keys)):
            self._clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if known.all():
            return place
        new = ~known
        for chunk in np.array_split(np.flatnonzero(new), -(-int(new.sum()) // 50_000)):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(K.strings(t.data, start[chunk], end[chunk]), add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            at = np.searchsorted(self.keys, keys[chunk])
            self.keys = np.insert(self.keys, at, keys[chunk])
            self.begin = np.insert(self.begin, at, self.used + np.cumsum(lengths) - lengths)
            self.length = np.insert(self.length, at, lengths)
            self.used += len(flat)
        return np.searchsorted(self.keys, keys)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; a Python worker keeps it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end` after each text's ids, and the counts with it."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1

"""Vectorised text primitives on Arrow string columns.

Every operator of this subpackage that has to look inside texts runs inside `mapInArrow` and works on whole
slices of a batch with numpy: no Python loop over documents or words. A slice is bounded by bytes, so memory is
bounded by `SLICE_BYTES` or by the longest single text, whichever is larger.

Words and n-grams are identified by 64-bit hashes. Two different words get the same hash with probability 2**-64.
Null texts are treated as empty texts; operators that must tell them apart look at the column's validity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
U64 = np.uint64

#: Bytes that end a word for `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, lower-case letters and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
_M1, _M2, _SEED = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0x2545F4914F6CDD1D)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts hold about `limit` bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    offsets = _offsets(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


@dataclass
class Texts:
    """The bytes of a slice's texts back to back, padded by 8 zero bytes; text i is data[starts[i]:ends[i]]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def size(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.starts, self.ends)


def texts(column: pa.Array) -> Texts:
    """Texts of a string column, null as empty."""
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column)
    size = int(offsets[-1] - offsets[0]) if len(offsets) else 0
    data = np.zeros(size + 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(column.buffers()[2], np.uint8, count=size, offset=int(offsets[0]))
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return Texts(data, offsets[:-1], offsets[1:])


@dataclass
class Spans:
    """Spans of bytes in order; `doc` is the row of the text that holds each, `first` the first span of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(t: Texts, inside: np.ndarray) -> Spans:
    """Maximal runs, within one text each, of positions where `inside` (a flag for each byte) holds."""
    n = t.size
    inside = inside[:n]
    begins = np.zeros(n + 1, bool)
    begins[t.starts[t.starts < t.ends]] = True
    start, end = inside.copy(), np.zeros(n + 1, bool)
    start[1:] &= ~inside[:-1] | begins[1:n]
    end[1:] = inside
    end[1:n] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    first = np.searchsorted(start, np.append(t.starts, n))
    first[-1] = len(start)
    return Spans(start, end, first, np.repeat(np.arange(len(t.starts)), np.diff(first)))


def words(t: Texts) -> Spans:
    """White-space separated words."""
    return spans(t, ~SPACE[t.data])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * _M2
    h = (h ^ (h >> U64(29))) * _M1
    return h ^ (h >> U64(32))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step. `data` must have 8 bytes of padding."""
    view = np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    h = mix(length.astype(U64) + _SEED)
    todo, at = np.arange(len(start)), start
    while len(todo):
        left = length[todo] - (at - start[todo])
        keep = left > 0
        if not keep.all():
            todo, at, left = todo[keep], at[keep], left[keep]
            if not len(todo):
                break
        part = view[at] & _MASKS[np.minimum(left, 8)]
        h[todo] = mix((h[todo] ^ part) * _M1)
        at = at + 8
    return h


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive hashes; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _M1
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start[i], start[i] + length[i])."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total) - np.repeat(begin - start, length)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one occurrence of each, and each element's index in the former."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(h)
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[order[1:]], h[order[:-1]], out=new[1:])
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return h[order[new]], order[new], inverse


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes back to back, and where each ends."""
    length = end - start
    return data[ranges(start, length)], np.cumsum(length)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Spans as strings, by one Arrow conversion."""
    raw, ends = gather(data, start, end)
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(raw)).to_pylist()

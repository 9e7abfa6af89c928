"""Documents as slices of word numbers, and sums over the corpus that find their way back to the slices.

A corpus-wide count of words or n-grams must be joined back to the documents that hold them. To do so without a row
for each word, documents are kept in slices: a slice holds some documents' words as numbers into its own list of
distinct words, and is a row of a written table. A slice sends each of its distinct keys once, with its count, packed
by fragment of the key space; a fragment sums the counts and sends the totals back in the order in which they came.
A key that a third of all documents hold is thus one entry a slice, and fragments are even.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import written

_SCHEMA = "slice long, n_docs long, n_tokens long, docs binary, valid binary, flags binary, first binary, number binary, words binary, lengths binary"
#: Keys that a fragment holds, about.
FRAGMENT_KEYS = 1 << 20


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of `width` bytes (4 or 8), all their lowest bytes first: high bytes that are mostly zero then compress."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def of_planes(raw: pa.Scalar, width: int = 4, skip: int = 0) -> np.ndarray:
    """The inverse of `planes`, as 64-bit numbers; `skip` bytes stand before them."""
    part = np.frombuffer(raw.as_buffer(), np.uint8)[skip:].reshape(width, -1)
    return np.ascontiguousarray(part.T).view(f"<u{width}")[:, 0].astype(np.int64)


def counts(x: np.ndarray) -> bytes:
    """Counts in 32 bits each, or 64 if one needs them; the first byte tells."""
    width = 8 if len(x) and int(x.max()) >> 32 else 4
    return bytes([width]) + planes(x, width)


def of_counts(raw: pa.Scalar) -> np.ndarray:
    """The inverse of `counts`."""
    return of_planes(raw, int.from_bytes(raw.as_buffer()[:1].to_pybytes()), 1)


#: Bands of frequencies: four to an octave.
BANDS = 256


def bands(df: np.ndarray) -> np.ndarray:
    """The band of each frequency; 1 is in band 0."""
    return np.floor(4 * np.log2(np.maximum(df, 1)) + 1e-9).astype(np.int64)


@dataclass
class Slice:
    """A row of the table: documents and their words; `flag` is the caller's mark of each document."""

    id: int
    docs: np.ndarray
    valid: np.ndarray
    flag: np.ndarray
    first: np.ndarray  # words before each document, and of all
    number: np.ndarray  # of each word, its place in the list of distinct words
    words: np.ndarray  # bytes of the distinct words, padded
    start: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, row: int) -> Slice:
        raw = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
        view = lambda name, kind: np.frombuffer(raw[name].as_buffer(), kind)
        end = np.cumsum(of_planes(raw["lengths"]))
        words = np.append(view("words", np.uint8), np.zeros(8, np.uint8))
        return Slice(
            raw["slice"].as_py(), view("docs", "<i8"), view("valid", np.uint8).astype(bool), view("flags", np.uint8), view("first", "<u4").astype(np.int64),
            of_planes(raw["number"]), words, np.append(0, end[:-1])[: len(end)], end,
        )

    @staticmethod
    def of_texts(column: pa.Array, flag: int) -> Slice:
        """A slice of texts that are in no table: without ids, all with one flag."""
        t, n = K.texts(column).lowered(), len(column)
        w = K.words(t)
        _, at, number = K.distinct(K.span_hash(t.data, w.start, w.end))
        words, end = K.gather(t.data, w.start[at], w.end[at])
        return Slice(0, np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, flag, np.uint8), w.first.astype(np.int64), number, np.append(words, np.zeros(8, np.uint8)), np.append(0, end[:-1])[: len(end)], end)

    @property
    def doc(self) -> np.ndarray:
        """Row of the document of each word."""
        return np.repeat(np.arange(len(self.docs)), np.diff(self.first))

    def only(self, docs: np.ndarray) -> Slice:
        """The slice with some of its documents (a flag each) and their words alone."""
        size = np.diff(self.first)
        number = self.number[np.repeat(docs, size)]
        used = np.flatnonzero(np.bincount(number, minlength=len(self.start)))
        place = np.zeros(len(self.start), np.int64)
        place[used] = np.arange(len(used))
        words, end = K.gather(self.words, self.start[used], self.end[used])
        return Slice(self.id, self.docs[docs], self.valid[docs], self.flag[docs], np.append(0, np.cumsum(size[docs])), place[number], np.append(words, np.zeros(8, np.uint8)), np.append(0, end[:-1])[: len(end)], end)

    def hashes(self) -> np.ndarray:
        """Hashes of the distinct words."""
        return K.span_hash(self.words, self.start, self.end)

    def nodes(self) -> np.ndarray:
        """A number for each document that no other document of the table has."""
        return (self.id << 20) + np.arange(len(self.docs))


def coded(docs: DataFrame, flag: Column | None = None, *, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int | None = None) -> DataFrame:
    """The table of slices, written. Words are white-space separated, A-Z lower-cased."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for s in K.slices(batch, 3, slice_bytes) if slice_bytes else K.slices(batch, 3):
                t = K.texts(s.column(3)).lowered()
                w = K.words(t)
                _, at, number = K.distinct(K.span_hash(t.data, w.start, w.end))
                words, ends = K.gather(t.data, w.start[at], w.end[at])
                ids, part = s.column(1), s.column(0)[0].as_py()
                blobs = [np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.uint8), np.asarray(s.column(2)).astype(np.uint8), w.first.astype("<u4")]
                blobs = [b.tobytes() for b in blobs] + [planes(number), words.tobytes(), planes(np.diff(ends, prepend=0))]
                head = [pa.array([x], pa.int64()) for x in ((part << 20) + n, s.num_rows, len(w))]
                n += 1
                yield pa.RecordBatch.from_arrays(head + [pa.array([b], pa.binary()) for b in blobs], names=["slice", "n_docs", "n_tokens", "docs", "valid", "flags", "first", "number", "words", "lengths"])

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_column).cast("long").alias("doc_id"), F.coalesce(flag if flag is not None else F.lit(0), F.lit(0)).cast("byte").alias("flag"), F.col(text_column).alias("text"))
    return written(rows.mapInArrow(encode, _SCHEMA), "coded")


def fragments_for(keys: int) -> int:
    """Bits of the key that name a fragment, for about so many keys in all."""
    return max(3, math.ceil(math.log2(max(1, keys) / FRAGMENT_KEYS)))


def totals(slices: DataFrame, keys: Callable[[Slice], tuple[np.ndarray, np.ndarray]], bits: int, *, whole: bool = False, frequent: int = 0) -> DataFrame:
    """Sums of counts over all slices: slice, fragment, totals (in the order of the slice's keys), and on one row of each fragment n_keys, n_sum and volume, the sums by band of frequency.

    Sums are exact below 2**53. `keys` gives a slice's sorted distinct 64-bit keys and their counts. Two keys that agree in the first 32 + bits
    bits count as one, unless `whole` keys are sent, which takes twice the room. Of these, `frequent` holds the keys with at least so many counts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Slice.of(batch, row)
                key, count = keys(s)
                cut = np.append(np.searchsorted(key, np.arange(1 << bits, dtype=K.U64) << K.U64(64 - bits)), len(key))
                low = (key >> K.U64(32 - bits)).astype("<u4")
                at = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(np.full(len(at), s.id)), pa.array([key[cut[i] : cut[i + 1]].tobytes() if whole else planes(np.diff(low[cut[i] : cut[i + 1]], prepend=low.dtype.type(0))) for i in at], pa.binary()), pa.array([counts(count[cut[i] : cut[i + 1]]) for i in at], pa.binary())],
                    names=["fragment", "slice", "keys", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        low = [np.frombuffer(x.as_buffer(), "<u8") if whole else np.cumsum(of_planes(x)) for x in group.column("keys")]
        n = np.concatenate([of_counts(x) for x in group.column("counts")])
        distinct, inverse = np.unique(np.concatenate(low), return_inverse=True)
        total = np.rint(np.bincount(inverse, n, minlength=len(distinct))).astype(np.int64)
        back, cut = total[inverse], np.cumsum([0, *map(len, low)])
        volume = np.bincount(bands(total), total, minlength=BANDS).astype(np.int64)
        return pa.table({
            "slice": group.column("slice"), "fragment": group.column("fragment"), "totals": pa.array([counts(back[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
            "n_keys": [int((total > 0).sum()), *[0] * (len(low) - 1)], "n_sum": [int(total.sum()), *[0] * (len(low) - 1)],
            "volume": pa.array([volume.tolist(), *[None] * (len(low) - 1)], pa.list_(pa.int64())),
            "frequent": pa.array([distinct[total >= frequent].tobytes() if whole and frequent else None, *[None] * (len(low) - 1)], pa.binary()),
        })

    sent = slices.mapInArrow(send, "fragment long, slice long, keys binary, counts binary")
    return sent.groupBy("fragment").applyInArrow(add, "slice long, fragment long, totals binary, n_keys long, n_sum long, volume array<long>, frequent binary")


def volume_by_band(sums: DataFrame) -> list[int]:
    """Sums of all counts by band of frequency."""
    rows = sums.select(F.posexplode("volume").alias("band", "n")).groupBy("band").agg(F.sum("n").alias("n")).collect()  # a row for each band
    found = {r["band"]: r["n"] for r in rows}
    return [found.get(i, 0) for i in range(BANDS)]


def with_totals(slices: DataFrame, sums: DataFrame) -> DataFrame:
    """The slices, each with its keys' totals as an array of (fragment, totals)."""
    back = sums.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("fragment", "totals"))).alias("sums"))
    return slices.join(back, "slice", "left").select(*slices.columns, "sums")


def totals_of(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The totals of a row of `with_totals`, in the order of the slice's keys."""
    sums = batch.column(batch.schema.get_field_index("sums"))[row]
    parts = [of_counts(x["totals"]) for x in sums] if sums.is_valid else []
    return np.concatenate([np.zeros(0, np.int64), *parts])

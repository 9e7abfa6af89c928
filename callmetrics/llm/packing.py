"""Operator 4, packing: minimum bin slack over a histogram of lengths.

A document's ids are cut into full windows and a remainder that is shorter than a window. How the remainders share
windows depends only on how many there are of each length, at most `window - 1` numbers whatever the corpus holds.
From these the driver makes patterns: a pattern is a multiset of lengths, found by a bitset subset-sum program that
comes closest to the window's capacity, and the number of times it is used, as often as the counts allow. Each
remainder finds its pattern, window and place by arithmetic from its rank among the remainders of its length; ranks
are counted within partitions and moved by the counts of the partitions before.

Windows that no multiset fills exactly are the exception. Their remainders are laid end to end and cut at multiples
of the window; what is left at the end is cut into powers of two, which need no padding.

Null texts count as empty: such a document has its end id alone. Repeated rows are packed each for itself. An empty
table gives no pieces. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .encoder import encoder, with_end
from .scratch import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Rows, of about 140 bytes each, that are broadcast at most.
BROADCAST_ROWS = 200_000


def _repeated(reach: int, length: int, count: int, mask: int) -> int:
    """Sums reachable by adding `length` up to `count` times."""
    step = 1
    while count > 0 and length * step <= mask.bit_length():
        take = min(step, count)
        reach |= (reach << (length * take)) & mask
        count -= take
        step *= 2
    return reach


def closest(target: int, counts: np.ndarray) -> dict[int, int]:
    """The multiset within `counts` (by length) whose sum is the largest that is at most `target`."""
    mask, reach, layers = (1 << (target + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: target + 1])[::-1].tolist():
        if reach >> target & 1:
            break
        layers.append((length, reach))
        reach = _repeated(reach, length, int(counts[length]), mask)
    left, out = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> (left - n * length) & 1:
            n += 1
        if n:
            out[length] = n
            left -= n * length
    return out


def patterns(counts: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of lengths and how often each is used, together all of `counts`; the largest length goes first."""
    counts, out = counts.copy(), []
    while len(lengths := np.flatnonzero(counts)):
        largest = int(lengths[-1])
        counts[largest] -= 1
        chosen = closest(window - largest, counts)
        counts[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        out.append((chosen, times))
    return out


@dataclass
class Layout:
    """Where the remainders go: intervals of ranks by length, in order. At most a few for each pattern."""

    window: int
    key: np.ndarray  # length << 40 | first rank
    per: np.ndarray  # pieces of that length in each use of the pattern
    sequence: np.ndarray  # of the first use; -1 for those laid end to end
    offset: np.ndarray  # in the window, or in the pool, of the first piece
    stride: np.ndarray  # of the pool's position between two uses
    pooled: int  # ids in the pool
    sequences: int  # windows filled exactly
    tail: np.ndarray  # starts of the last windows of the pool, powers of two

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence (-1: in the pool), offset in it, and position in the pool."""
        i = np.searchsorted(self.key, (length << 40) | rank, "right") - 1
        use, nth = np.divmod(rank - (self.key[i] & ((1 << 40) - 1)), self.per[i])
        at = self.offset[i] + nth * length
        return np.where(self.sequence[i] < 0, -1, self.sequence[i] + use), at, at + use * self.stride[i]

    @property
    def pool_sequences(self) -> int:
        return self.pooled // self.window + len(self.tail)


def layout(counts: np.ndarray, window: int) -> Layout:
    rows, used, sequences, pooled = [], np.zeros(window, np.int64), 0, 0
    for chosen, times in patterns(counts, window):
        total, at = sum(k * n for k, n in chosen.items()), 0
        exact = total & (total - 1) == 0 or total == window
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length << 40 | int(used[length]), n, sequences if exact else -1, at + (0 if exact else pooled), 0 if exact else total))
            used[length] += n * times
            at += length * n
        sequences, pooled = (sequences + times, pooled) if exact else (sequences, pooled + total * times)
    rows.sort()
    key, per, sequence, offset, stride = np.array(rows, np.int64).reshape(-1, 5).T
    rest, at, tail = pooled % window, pooled - pooled % window, []
    for bit in range(window.bit_length(), -1, -1):
        if rest >> bit & 1:
            tail.append(at)
            at += 1 << bit
    return Layout(window, key, per, sequence, offset, stride, pooled, sequences, np.array(tail, np.int64))


def tokens(docs: DataFrame, vocabulary_file: str, end: int, window: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of each text, written: part, rest (length of the remainder), rank (within part and rest), doc_id, n, windows (full ones before it in its part), ids (16 or 32 bits)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, full = encoder(vocabulary_file), np.zeros(window, np.int64), 0
        for batch in batches:
            for s in K.slices(batch, 2):
                ids, counts = with_end(*enc.encode(K.texts(s.column(2))), end)
                rest = counts % window
                order = np.argsort(rest, kind="stable")
                group = rest[order]
                rank = np.empty(len(rest), np.int64)
                rank[order] = np.arange(len(rest)) - np.searchsorted(group, group) + seen[group]
                seen += np.bincount(rest, minlength=window)
                whole = counts // window
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                raw = ids.astype("<u4").tobytes()
                cut = np.append(0, np.cumsum(counts)) * 4
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cut), pa.py_buffer(raw)])
                if enc.tokenizer.get_vocab_size() <= 1 << 16:
                    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(cut // 2), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(rest), pa.array(rank), s.column(1), pa.array(counts), pa.array(before), blob.cast(pa.binary())], names=["part", "rest", "rank", "doc_id", "n", "windows", "ids"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return written(rows.mapInArrow(encode, "part int, rest long, rank long, doc_id long, n long, windows long, ids binary"), "packing-ids")


def pack(ids: DataFrame, window: int = 4096, *, with_ids: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (32 bits) if asked for."""
    spark = ids.sparkSession
    sizes = ids.groupBy("part", "rest").agg(F.count("*").alias("n_rows"), F.sum(F.expr(f"n div {window}")).alias("n_windows"))
    sizes = written(sizes, "packing-sizes")
    counts = np.zeros(window, np.int64)
    for rest, n in sizes.filter("rest > 0").groupBy("rest").agg(F.sum("n_rows")).collect():  # at most window - 1 rows
        counts[rest] = n
    plan = layout(counts, window)
    ranks = sizes.select("part", "rest", F.coalesce(F.sum("n_rows").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_base"))
    parts = sizes.groupBy("part").agg(F.sum("n_windows").alias("n_windows"))  # a row for each partition of the input
    parts = parts.select("part", F.coalesce(F.sum("n_windows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("window_base"))
    # A row for each part and length: broadcast while there are few, else joined by a shuffle of the ids.
    ranks = ranks.join(parts, "part")
    ranks = F.broadcast(ranks) if sizes.count() <= broadcast_rows else ranks.hint("merge")
    placed = ids.join(ranks, ["part", "rest"]).select("doc_id", "n", "rest", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("windows") + F.col("window_base")).alias("windows"), "ids")
    shared = spark.sparkContext.broadcast(plan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lay: Layout = shared.value
        for batch in batches:
            step = max(1, batch.num_rows * (8 << 20) // max(1, batch.nbytes))
            for first in range(0, batch.num_rows, step):
                yield _pieces(batch.slice(first, step), lay, with_ids)

    return placed.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def _pieces(batch: pa.RecordBatch, lay: Layout, with_ids: bool) -> pa.RecordBatch:
    doc, (n, rest, rank, before) = batch.column(0), (np.asarray(batch.column(i)) for i in range(1, 5))
    whole, w = n // lay.window, lay.window
    rows = np.repeat(np.arange(len(n)), whole)
    nth = K.ranges(np.zeros(len(n), np.int64), whole)
    parts = [(rows, nth * w, np.full(len(rows), w), lay.sequences + lay.pool_sequences + before[rows] + nth, np.zeros(len(rows), np.int64))]
    short = np.flatnonzero(rest)
    sequence, offset, pool = lay.place(rest[short], rank[short])
    fit = sequence >= 0
    parts.append((short[fit], whole[short[fit]] * w, rest[short[fit]], sequence[fit], offset[fit]))
    # In the pool a remainder may span several of its windows: the last ones are powers of two.
    left, at = short[~fit], pool[~fit]
    done, full = np.zeros(len(left), np.int64), lay.pooled // w
    while len(left):
        i = np.searchsorted(lay.tail, at, "right")
        window = np.where(i > 0, full + i - 1, at // w)
        begin = np.where(i > 0, lay.tail[np.maximum(i - 1, 0)] if len(lay.tail) else 0, at // w * w)
        ends = np.append(lay.tail[1:], lay.pooled) if len(lay.tail) else np.zeros(1, np.int64)
        end = np.where(i > 0, ends[np.maximum(i - 1, 0)], at // w * w + w)
        take = np.minimum(rest[left] - done, end - at)
        parts.append((left, whole[left] * w + done, take, lay.sequences + window, at - begin))
        done, at = done + take, at + take
        more = done < rest[left]
        left, done, at = left[more], done[more], at[more]
    row, start, length, sequence, offset = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5))
    order = np.lexsort((start, row))
    row, start, length, sequence, offset = row[order], start[order], length[order], sequence[order], offset[order]
    blobs = batch.column(5)
    kind = "<u2" if len(blobs[0].as_buffer()) == 2 * int(n[0]) else "<u4"
    raws, now, crc, out = None, -1, [], []
    for r, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
        if r != now:
            now, raws = r, memoryview(np.frombuffer(blobs[r].as_buffer(), kind).astype("<u4").tobytes())
        crc.append(zlib.crc32(raws[4 * a : 4 * (a + k)]))
        if with_ids:
            out.append(bytes(raws[4 * a : 4 * (a + k)]))
    columns = [doc.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(offset)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(columns + ([pa.array(out, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)


def query_docs(docs: DataFrame, *, with_ids: bool = False) -> DataFrame:
    import public_tokenizers

    return pack(tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, window=4096), 4096, with_ids=with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in sequences of at most 4096 tokens."""
    return query_docs(spark.read.parquet(f"{sf_dir}/documents.parquet"))

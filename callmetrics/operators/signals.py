"""Recordings as blocks of samples, and blocks as frames.

A block is (call_id, sample_rate, start_sample, samples). Long recordings are many rows, so no task needs one whole. Blocks
may carry `after`, the first `OVERLAP` samples of the next block, so that overlapping frames need no shuffle.
All operators on blocks aggregate in two steps: within a block by higher-order functions, then by call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder

#: Samples in a block: a multiple of the 20 ms frames (320) and of the hops (256) of 16 kHz audio.
BLOCK = 64_000
#: Samples of the next block that a block carries: those that frames of 512 samples every 256 reach over its end.
OVERLAP = 256
#: Rows that are numbered together, about.
BUCKET_ROWS = 1 << 22


def blocked(signals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of recordings that are given as one array each. `block` must be a multiple of the frames used later."""
    n = F.size("samples")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block))).otherwise(F.array(F.lit(0)))
    return signals.select("call_id", "sample_rate", "samples", F.explode(starts).alias("s")).select(
        "call_id", "sample_rate", F.col("s").cast("long").alias("start_sample"), F.slice("samples", F.col("s") + 1, F.lit(block)).alias("samples"), F.slice("samples", F.col("s") + block + 1, F.lit(OVERLAP)).alias("after")
    )


def from_rows(rows: DataFrame, order: list[str], block: int = BLOCK, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Blocks of recordings that are given as one row a sample: call_id, sample_rate, value.

    More than `bucket_rows` rows are written in ranges of the order, of about so many rows of all calls each, and numbered
    in these, after the call's rows in earlier ranges. No array is longer than a block, and no task numbers more than a range, however long a recording.
    """
    key, n = ["call_id", "sample_rate"], -(-rows.count() // bucket_rows)
    ranges = rows.select(*dict.fromkeys([*key, *order, "value"])).withColumn("_bucket", F.lit(0))
    if n > 1:
        path = shared_folder(rows.sparkSession, "samples")
        ranges.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()).write.parquet(path)
        ranges = rows.sparkSession.read.schema(ranges.schema).parquet(path)
    at = F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*order, "value")).cast("long") - 1
    numbered = ranges.withColumn("_at", at)
    if n > 1:
        before = F.sum("_n").over(Window.partitionBy("_call", "_rate").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        counts = ranges.groupBy(F.col("call_id").alias("_call"), F.col("sample_rate").alias("_rate"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        same = F.col("call_id").eqNullSafe(F.col("_call")) & F.col("sample_rate").eqNullSafe(F.col("_rate")) & (F.col("_bucket") == F.col("_b"))
        numbered = numbered.join(counts, same).withColumn("_at", F.col("_at") + F.col("_before"))
    of_block = numbered.groupBy(*key, F.expr(f"_at div {block}").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("s"))
    return of_block.select(*key, (F.col("_block") * block).alias("start_sample"), F.transform("s", lambda v: v["value"].cast("float")).alias("samples"))


def frames(blocks: DataFrame, size: int) -> DataFrame:
    """Tumbling frames: call_id, sample_rate, frame_idx, frame. An incomplete last frame is dropped."""
    whole = F.expr(f"size(samples) div {size}")
    cut = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole.cast("int") - 1), lambda i: F.slice("samples", i * size + 1, size))).otherwise(F.array().cast("array<array<float>>"))
    return blocks.select("call_id", "sample_rate", F.expr(f"start_sample div {size}").alias("f"), F.posexplode(cut).alias("i", "frame")).select("call_id", "sample_rate", (F.col("f") + F.col("i")).cast("long").alias("frame_idx"), "frame")


def _flat(samples: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of lists, and where each list begins and ends among them; a null list is empty."""
    offsets = np.asarray(samples.offsets).astype(np.int64)
    return np.asarray(samples.values.fill_null(0.0)), offsets[:-1], np.where(np.asarray(samples.is_valid()), offsets[1:], offsets[:-1])


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start[i], start[i] + length[i])."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _framed(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks of a batch: their samples back to back, where each begins and ends, its number of whole frames, and each frame's power (mean square, in doubles) and changes of sign (that of -0.0 included)."""
    x, begin, end = _flat(batch.column(3))
    whole = (end - begin) // size
    power, crossings = np.zeros(0), np.zeros(0, np.int64)
    if whole.any():
        at = _ranges(begin, whole * size)
        frame = (x if len(at) == len(x) else x[at]).reshape(-1, size)
        square = frame.astype(np.float64)
        np.multiply(square, square, out=square)
        sign = np.signbit(frame)
        power, crossings = square.sum(axis=1) / size, (sign[:, 1:] != sign[:, :-1]).sum(axis=1)
    return x, begin, end, whole, power, crossings


def _blocks_for(blocks: DataFrame) -> tuple[DataFrame, str]:
    """The columns that the measures read, and the type of call_id."""
    return blocks.select("call_id", F.col("sample_rate").cast("int"), F.col("start_sample").cast("long"), "samples"), dict(blocks.dtypes)["call_id"]


def measured(blocks: DataFrame, size: int) -> DataFrame:
    """Tumbling frames by their measures alone, one pass over the samples: call_id, sample_rate, n, frame_idx, power, crossings, and for a block without a whole frame short_size, short_power, short_crossings of an even number of its samples.

    `n`, the samples of the block, stands on one row of each block, also of a block without a frame, which has no frame's value there.
    """
    names = ["call_id", "sample_rate", "n", "frame_idx", "power", "crossings", "short_size", "short_power", "short_crossings"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, begin, end, whole, power, crossings = _framed(batch, size)
            rows = np.maximum(whole, 1)
            row = np.repeat(np.arange(len(whole)), rows)
            place = _ranges(np.zeros(len(rows), np.int64), rows)
            there = whole[row] > 0
            spread = np.cumsum(there) - 1
            value = lambda v: pa.array(v[np.maximum(spread, 0)] if len(v) else np.zeros(len(row), v.dtype), mask=~there)  # noqa: B023, E731
            index = np.asarray(batch.column(2)).astype(np.int64)[row] // size + place
            even, low, turns = np.zeros(len(whole), np.int64), np.zeros(len(whole)), np.zeros(len(whole), np.int64)
            for i in np.flatnonzero((whole == 0) & (end - begin >= 2)):
                part = x[begin[i] : begin[i] + (end[i] - begin[i]) // 2 * 2]
                even[i], low[i], turns[i] = len(part), np.mean(part.astype(np.float64) ** 2), np.count_nonzero(np.diff(np.signbit(part)))
            short = lambda v: pa.array(v[row], mask=even[row] == 0)  # noqa: B023, E731
            columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array((end - begin)[row], mask=place > 0), pa.array(index, mask=~there), value(power), value(crossings), short(even), short(low), short(turns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows, kind = _blocks_for(blocks)
    return rows.mapInArrow(measure, f"call_id {kind}, sample_rate int, n long, frame_idx long, power double, crossings long, short_size long, short_power double, short_crossings long")


def _runs_of(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of set flags; a run ends where the owner changes."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.append(True, owner[1:] != owner[:-1])
    start = np.flatnonzero(flag & np.append(True, ~flag[:-1] | other[1:]))
    end = np.flatnonzero(flag & np.append(~flag[1:] | other[1:], True)) + 1
    return start, end - start


def _pieces(batch: pa.RecordBatch, totals: list[pa.Array], row: np.ndarray, start: np.ndarray, length: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row of totals for each block, then a row for each run."""
    n, k = batch.num_rows, len(row)
    where = pa.array(np.append(np.arange(n), row))
    first = np.append(np.zeros(n, bool), np.ones(k, bool))
    filled = lambda v: pa.array(np.append(np.zeros(n, np.int64), v), mask=~first)
    return pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), *[pa.concat_arrays([t, pa.nulls(k, t.type)]) for t in totals], filled(start), filled(length)], names=["call_id", "sample_rate", *names, "start", "length"])


def quiet_runs(blocks: DataFrame, size: int, below: float) -> DataFrame:
    """Runs of frames whose RMS is below a limit, one pass: call_id, sample_rate, start, length (in frames) of each run within a block, and a row for each block with n samples, frames, quiet ones, the first and the last that is not. `joined_runs` puts runs together that go on in the next block."""
    names = ["n", "frames", "quiet", "first_loud", "last_loud"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, begin, end, whole, power, _ = _framed(batch, size)
            owner = np.repeat(np.arange(len(whole)), whole)
            index = np.asarray(batch.column(2)).astype(np.int64)[owner] // size + _ranges(np.zeros(len(whole), np.int64), whole)
            quiet = np.sqrt(power) < below
            loud = np.flatnonzero(~quiet)
            some = np.isin(np.arange(len(whole)), owner[loud])
            low, high = np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)
            low[owner[loud][::-1]], high[owner[loud]] = index[loud][::-1], index[loud]
            start, length = _runs_of(quiet, owner)
            totals = [pa.array(end - begin), pa.array(whole), pa.array(np.bincount(owner[quiet], minlength=len(whole)).astype(np.int64)), pa.array(low, mask=~some), pa.array(high, mask=~some)]
            yield _pieces(batch, totals, owner[start], index[start], length, names)

    rows, kind = _blocks_for(blocks)
    return rows.mapInArrow(measure, f"call_id {kind}, sample_rate int, " + ", ".join(f"{c} long" for c in [*names, "start", "length"]))


def pinned_runs(blocks: DataFrame, full_scale: float) -> DataFrame:
    """Runs of samples at full scale, one pass: call_id, sample_rate, start, length (in samples) of each run within a block, and a row for each block with its n samples and peak."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, begin, end = _flat(batch.column(3))
            size = np.abs(x)
            top = np.array([size[a:b].max(initial=0.0) for a, b in zip(begin, end, strict=True)], np.float64)
            at = np.flatnonzero(size.astype(np.float64) >= full_scale)
            owner = np.searchsorted(begin, at, "right") - 1
            at, owner = at[at < end[owner]], owner[at < end[owner]]
            index = np.asarray(batch.column(2)).astype(np.int64)[owner] + at - begin[owner]
            new = np.append(True, (index[1:] != index[:-1] + 1) | (owner[1:] != owner[:-1])) if len(at) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            yield _pieces(batch, [pa.array(end - begin), pa.array(top)], owner[start], index[start], np.diff(np.append(start, len(at))), ["n", "peak"])

    rows, kind = _blocks_for(blocks)
    return rows.mapInArrow(measure, f"call_id {kind}, sample_rate int, n long, peak double, start long, length long")


def joined_runs(pieces: DataFrame) -> DataFrame:
    """The rows with `run`, the number of the call's run that each piece belongs to: pieces that touch are one run. Rows without a piece have run 0. Only pieces are sorted, never frames or samples."""
    w = Window.partitionBy("call_id").orderBy("start")
    before = F.max(F.col("start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start").isNotNull(), (F.coalesce(before, F.lit(-1)) != F.col("start")).cast("int")).otherwise(0)
    return pieces.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_after(blocks: DataFrame, most: int) -> DataFrame:
    """The blocks with `after`, at least `most` samples of what follows each in its call; blocks that have enough of it stay as they are."""
    if "after" in blocks.columns and most <= OVERLAP:
        return blocks
    return blocks.withColumn("after", F.slice(F.lead("samples").over(Window.partitionBy("call_id").orderBy("start_sample")), 1, most))


def hop_frames(samples: pa.ListArray, after: pa.ListArray, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping frames of the blocks of a batch, each of `window` samples, every `step`: all samples with what follows each block, where each block's first frame starts there, and its number of frames. A block owns the frames that begin in it."""
    x, begin, end = _flat(samples)
    y, from_, to = _flat(after)
    size, more = end - begin, np.minimum(to - from_, window - step)
    start = np.cumsum(size + more) - (size + more)
    flat = np.empty(int((size + more).sum()), np.float32)
    flat[_ranges(start, size)] = x[_ranges(begin, size)]
    flat[_ranges(start + size, more)] = y[_ranges(from_, more)]
    own = np.minimum((size + more - window) // step + 1, -(-size // step))
    return flat, start, np.where(size + more >= window, np.maximum(own, 0), 0)


def hops(blocks: DataFrame, window: int, step: int) -> DataFrame:
    """Overlapping frames as rows (call_id, sample_rate, frame_idx, frame), for measures of one's own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begin, count = hop_frames(batch.column(3), batch.column(4), window, step)
            row = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            values = flat[(begin[row] + step * place)[:, None] + np.arange(window)].reshape(-1)
            frame = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * window, pa.int32()), pa.array(values, pa.float32()))
            index = np.asarray(batch.column(2)).astype(np.int64)[row] // step + place
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(index), frame], names=["call_id", "sample_rate", "frame_idx", "frame"])

    kind = dict(blocks.dtypes)["call_id"]
    rows = with_after(blocks, window - step).select("call_id", F.col("sample_rate").cast("int"), F.col("start_sample").cast("long"), "samples", "after")
    return rows.mapInArrow(cut, f"call_id {kind}, sample_rate int, frame_idx long, frame array<float>")


def power(frame: str = "frame"):
    """Mean square of a frame, in doubles."""
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(frame)


def runs(flags: DataFrame, key: list[str], index: str = "idx") -> DataFrame:
    """Runs of consecutive indices among the rows given: key, start, length."""
    w = Window.partitionBy(*key).orderBy(index)
    return flags.withColumn("_island", F.col(index) - F.row_number().over(w)).groupBy(*key, "_island").agg(F.min(index).alias("start"), F.count("*").alias("length")).drop("_island")


def bridged(flags: DataFrame, key: list[str], max_gap: int, index: str = "idx") -> DataFrame:
    """Runs of the rows' indices where gaps of at most `max_gap` missing indices count as filled: key, start, length."""
    w = Window.partitionBy(*key).orderBy(index)
    new = F.coalesce(F.col(index) - F.lag(index).over(w) - 1 > max_gap, F.lit(True)).cast("int")
    return flags.withColumn("_new", new).withColumn("_segment", F.sum("_new").over(w)).groupBy(*key, "_segment").agg(F.min(index).alias("start"), (F.max(index) - F.min(index) + 1).alias("length")).drop("_segment")

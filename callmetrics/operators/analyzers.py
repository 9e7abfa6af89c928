"""The eight measurements of a recording.

Each takes blocks and gives one row a call with `status` SUCCESS or SKIPPED; a skipped call has null measurements.
Parameters default to those of 16 kHz telephone audio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amplitude_db, amplitude_of, power_db
from .signals import hop_frames, joined_runs, measured, pinned_runs, quiet_runs, with_after

FRAME_SECONDS = 0.020


def frame_size(sample_rate: int, least: int = 1) -> int:
    return max(least, int(sample_rate * 20 / 1000))


def _settled(df: DataFrame, skipped: Column, columns: dict[str, Column]) -> DataFrame:
    return df.select("call_id", F.when(skipped, "SKIPPED").otherwise("SUCCESS").alias("status"), *[F.when(~skipped, c).alias(k) for k, c in columns.items()])


def duration_rms(blocks: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Duration, level and peak. `references` (call_id, duration_seconds) adds what the reference claims."""
    x2 = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    agg = blocks.groupBy("call_id").agg(F.first("sample_rate").alias("sample_rate"), F.sum(F.size("samples")).cast("long").alias("samples"), F.sum(x2).alias("x2"), F.max(top).alias("peak"))
    if references is not None:
        agg = agg.join(references.select("call_id", F.col("duration_seconds").alias("reference_duration_seconds")), "call_id", "left")
    rms = F.sqrt(F.col("x2") / F.col("samples"))
    columns = {"duration_seconds": F.col("samples") / F.col("sample_rate"), "sample_rate": F.col("sample_rate"), "samples": F.col("samples"), "rms": rms, "peak": F.col("peak"), "dbfs": amplitude_db(rms)}
    if references is not None:
        columns["reference_duration_seconds"] = F.col("reference_duration_seconds")
    return _settled(agg, F.col("samples") == 0, columns)


def _size() -> tuple[Column, Column]:
    """Rate and size of a call, over rows with the samples `n` of its blocks."""
    return F.first("sample_rate").alias("sample_rate"), F.sum("n").alias("samples")


def silence_ratio(blocks: DataFrame, frame: int = 320, threshold_dbfs: float = -50.0) -> DataFrame:
    """Share and length of silence; a frame is silent below the threshold."""
    pieces = joined_runs(quiet_runs(blocks, frame, 10.0 ** (threshold_dbfs / 20.0)))
    by_run = pieces.groupBy("call_id", "run").agg(F.first("sample_rate").alias("sample_rate"), *[F.sum(c).alias(c) for c in ("n", "frames", "quiet", "length")], F.min("first_loud").alias("first_loud"), F.max("last_loud").alias("last_loud"))
    df = by_run.groupBy("call_id").agg(*_size(), F.sum("frames").alias("frames"), F.sum("quiet").alias("silent"), F.max("length").alias("longest"), F.min("first_loud").alias("first_loud"), F.max("last_loud").alias("last_loud"))
    n = F.col("frames")
    seconds = lambda c: c * frame / F.col("sample_rate")
    return _settled(df, F.col("samples") == 0, {
        "silence_ratio": F.when(n > 0, F.col("silent") / n).otherwise(0.0),
        "silent_seconds": seconds(F.col("silent")),
        "longest_silence_seconds": seconds(F.coalesce("longest", F.lit(0))),
        "leading_silence_seconds": seconds(F.coalesce("first_loud", n)),
        "trailing_silence_seconds": seconds(F.coalesce(n - 1 - F.col("last_loud"), n)),
        "frames": n.cast("long"), "threshold_dbfs": F.lit(threshold_dbfs),
    })


def clipping(blocks: DataFrame, full_scale: float = 0.999, min_run: int = 3) -> DataFrame:
    """Runs of samples at full scale."""
    by_run = joined_runs(pinned_runs(blocks, full_scale)).groupBy("call_id", "run").agg(F.first("sample_rate").alias("sample_rate"), F.sum("n").alias("n"), F.max("peak").alias("peak"), F.sum("length").alias("length"))
    long = F.when(F.col("length") >= min_run, F.col("length"))
    df = by_run.groupBy("call_id").agg(*_size(), F.max("peak").alias("peak"), F.sum("length").alias("pinned"), F.sum(long).alias("clipped"), F.count(long).alias("events"), F.max(long).alias("longest"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return _settled(df, F.col("samples") == 0, {
        "clipped": n("events") > 0, "clipped_sample_ratio": n("clipped") / F.col("samples"), "clipped_seconds": n("clipped") / F.col("sample_rate"),
        "clip_events": n("events"), "longest_clip_samples": n("longest"), "full_scale_samples": n("pinned"), "peak": F.col("peak"),
    })


def zero_crossing_rate(blocks: DataFrame, frame: int = 320, threshold_dbfs: float = -50.0) -> DataFrame:
    """Sign changes a second within frames. A call shorter than a frame, which is one block, is one frame of an even number of samples."""
    limit = amplitude_of(threshold_dbfs)
    f = measured(blocks, frame).withColumns({"rate": F.col("crossings") / (F.lit(frame) / F.col("sample_rate")), "voiced": F.sqrt("power") >= limit})
    short_rate, short_voiced = F.col("short_crossings") / (F.col("short_size") / F.col("sample_rate")), F.sqrt("short_power") >= limit
    agg = f.groupBy("call_id").agg(
        *_size(), F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"), F.avg(F.when(F.col("voiced"), F.col("rate"))).alias("voiced_rate"), F.avg(F.col("voiced").cast("double")).alias("voiced_ratio"), F.count("power").alias("frames"),
        F.max(short_rate).alias("short_rate"), F.max(short_voiced.cast("double")).alias("short_voiced"),
    )
    alone = F.col("frames") == 0
    return _settled(agg, F.col("samples") < 2, {
        "zcr_per_second": F.when(alone, F.col("short_rate")).otherwise(F.col("mean")), "zcr_std": F.when(alone, F.lit(0.0)).otherwise(F.col("std")),
        "voiced_zcr_per_second": F.when(alone, F.col("short_rate") * F.col("short_voiced")).otherwise(F.coalesce("voiced_rate", F.lit(0.0))),
        "voiced_frame_ratio": F.when(alone, F.col("short_voiced")).otherwise(F.col("voiced_ratio")), "frames": F.greatest("frames", F.lit(1)),
    })


def snr_estimate(blocks: DataFrame, frame: int = 320, least_frames: int = 10) -> DataFrame:
    """Loud against quiet frames: the 90th and the 10th percentile of frame power."""
    agg = measured(blocks, frame).groupBy("call_id").agg(F.percentile("power", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.count("power").alias("frames"))
    df = agg.withColumns({"noise": F.col("q")[0], "signal": F.col("q")[1]})
    skipped = (F.col("frames") < least_frames) | (F.coalesce("signal", F.lit(0.0)) <= 0)
    noise, signal = F.col("noise"), F.col("signal")
    return _settled(df, skipped, {
        "snr_db": F.when(noise > 0, F.least(F.lit(100.0), 10.0 * F.log10(signal / noise))).otherwise(100.0), "noise_floor_dbfs": power_db(noise, -100.0), "signal_dbfs": power_db(signal, -100.0),
        "confidence": F.least(F.lit(1.0), (F.log10(signal + 1e-20) - F.log10(noise + 1e-20)) / 3.0), "frames": F.col("frames"),
    })


def spectra(blocks: DataFrame, window: int = 512, step: int = 256, fraction: float = 0.85) -> DataFrame:
    """Of each hopping frame: call_id, sample_rate, n, frame_idx, rms (not windowed), magnitude, centroid, rolloff, flatness.

    One pass: frames are views of a block and of the samples after it, and many share a transform. `n`, the samples of the block,
    stands on one row of each block, also of a block without a frame, which has no other value there.
    """
    names = ["call_id", "sample_rate", "n", "frame_idx", "rms", "magnitude", "centroid", "rolloff", "flatness"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taper, at_once = np.hanning(window), max(1, (1 << 20) // window)
        for batch in batches:
            flat, begin, count = hop_frames(batch.column(3), batch.column(4), window, step)
            rate = np.asarray(batch.column(1).fill_null(0)).astype(np.float64)
            row = np.repeat(np.arange(len(count)), count)
            first = np.repeat(begin - step * (np.cumsum(count) - count), count) + step * np.arange(len(row))
            out = np.zeros((5, len(row)))
            for i in range(0, len(row), at_once):
                part = slice(i, i + at_once)
                x = flat[first[part][:, None] + np.arange(window)].astype(np.float64)
                s = np.abs(np.fft.rfft(x * taper, axis=1))
                f = np.arange(s.shape[1]) / window * rate[row[part]][:, None]
                total = s.sum(axis=1)
                reached = (np.cumsum(s, axis=1) >= fraction * total[:, None]).argmax(axis=1)
                p = s**2 + 1e-10
                out[:, part] = np.sqrt((x**2).mean(axis=1)), total, (f * s).sum(axis=1) / np.where(total > 0, total, 1.0), f[np.arange(len(f)), reached], np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1)
            bare = np.flatnonzero(count == 0)
            where = np.append(row, bare)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            there = np.arange(len(where)) < len(row)
            index = np.asarray(batch.column(2)).astype(np.int64)[row] // step + place
            spread = lambda v, none: pa.array(np.append(v, np.zeros(len(bare), v.dtype)), mask=none)  # noqa: E731, B023
            size = pa.array(np.asarray(pc.fill_null(pc.list_value_length(batch.column(3)), 0)).astype(np.int64)[where], mask=np.append(place > 0, np.zeros(len(bare), bool)))
            columns = [batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where)), size, spread(index, ~there), *[spread(v, ~there) for v in out]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(blocks.dtypes)["call_id"]
    rows = with_after(blocks, window - step).select("call_id", F.col("sample_rate").cast("int"), F.col("start_sample").cast("long"), "samples", "after")
    return rows.mapInArrow(measure, f"call_id {kind}, sample_rate int, n long, frame_idx long, " + ", ".join(f"{c} double" for c in names[4:]))


def spectral_centroid(blocks: DataFrame, window: int = 512, step: int = 256, threshold_dbfs: float = -50.0) -> DataFrame:
    """Mean, spread and percentiles of the centroid over loud frames with any energy."""
    c = F.when((F.col("magnitude") > 0) & (F.col("rms") >= amplitude_of(threshold_dbfs)), F.col("centroid"))
    agg = spectra(blocks, window, step).withColumn("c", c).groupBy("call_id").agg(*_size(), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"), F.percentile("c", F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.count("c").alias("measured"), F.count("frame_idx").alias("frames"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return _settled(agg, F.col("samples") < window, {
        "centroid_hz": zero("mean"), "centroid_std_hz": zero("std"), "centroid_p10_hz": zero(F.col("q")[0]), "centroid_p90_hz": zero(F.col("q")[1]), "measured_frames": F.col("measured"), "frames": F.col("frames"), "nyquist_hz": F.col("sample_rate") / 2,
    })


def spectral_rolloff(blocks: DataFrame, window: int = 512, step: int = 256, fraction: float = 0.85, threshold_dbfs: float = -50.0) -> DataFrame:
    """Where most of the energy lies, and how flat the spectrum is, over loud frames."""
    loud = F.col("rms") >= amplitude_of(threshold_dbfs)
    s = spectra(blocks, window, step, fraction).withColumns({"r": F.when(loud, F.col("rolloff")), "f": F.when(loud, F.col("flatness"))})
    df = s.groupBy("call_id").agg(*_size(), F.avg("r").alias("mean"), F.percentile("r", 0.9).alias("p90"), F.avg("f").alias("flat"), F.count("r").alias("measured"), F.count("frame_idx").alias("frames"))
    return _settled(df, (F.col("samples") < window) | (F.col("measured") == 0), {
        "rolloff_hz": F.col("mean"), "rolloff_p90_hz": F.col("p90"), "flatness": F.col("flat"), "measured_frames": F.col("measured"), "frames": F.col("frames"), "rolloff_fraction": F.lit(fraction), "band_limited": F.col("mean") < 0.75 * F.col("sample_rate") / 2,
    })


def _segments(blocks: DataFrame, frame: int, above_db: float, max_gap: int) -> DataFrame:
    """Of each call its segments, and as segment 0 what is before them: n, frames, noise, threshold, start, length (null without an active frame). One pass over the samples, one shuffle."""
    f = measured(blocks, frame).select("call_id", "sample_rate", "n", F.col("frame_idx").alias("idx"), "power")
    call = Window.partitionBy("call_id")
    w = call.orderBy("idx")
    f = f.withColumn("noise", F.percentile("power", 0.1).over(call))
    f = f.withColumn("threshold", F.when(F.col("noise") <= 0, 1e-5).otherwise(F.col("noise") * 10.0 ** (above_db / 10.0)))
    f = f.withColumn("on", F.when(F.col("power") > F.col("threshold"), F.col("idx")))
    before = F.max("on").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("on").isNotNull(), F.coalesce(F.col("on") - before - 1 > max_gap, F.lit(True)).cast("int")).otherwise(0)
    f = f.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy("call_id", "segment").agg(F.first("sample_rate").alias("sample_rate"), F.sum("n").alias("n"), F.count("power").alias("frames"), F.first("noise").alias("noise"), F.first("threshold").alias("threshold"), F.min("on").alias("start"), (F.max("on") - F.min("on") + 1).alias("length"))


def speech_segments(blocks: DataFrame, frame: int = 320, above_db: float = 12.0, max_gap: int = 15, min_segment: int = 10) -> DataFrame:
    """Segments of speech: call_id, start, length, in frames. Calls with too few frames are the caller's to leave out."""
    return _segments(blocks, frame, above_db, max_gap).filter(F.col("length") >= min_segment).select("call_id", "start", "length")


def energy_vad(blocks: DataFrame, frame: int = 320, above_db: float = 12.0, max_gap: int = 15, min_segment: int = 10, least_frames: int = 10) -> DataFrame:
    """Speech by energy above the noise floor."""
    s = _segments(blocks, frame, above_db, max_gap)
    kept = lambda c: F.when(F.col("length") >= min_segment, F.col(c))
    df = s.groupBy("call_id").agg(
        *_size(), F.sum("frames").alias("frames"), F.first("threshold").alias("threshold"),
        F.count(kept("length")).alias("segments"), F.sum(kept("length")).alias("speech"), F.avg(kept("length")).alias("mean"), F.max(kept("length")).alias("longest"), F.min(kept("start")).alias("first"),
    )
    seconds = lambda c: c * frame / F.col("sample_rate")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _settled(df, F.col("frames") < least_frames, {
        "speech_ratio": zero("speech") / F.col("frames"), "speech_seconds": seconds(zero("speech")), "segments": zero("segments").cast("long"), "mean_segment_seconds": seconds(F.coalesce("mean", F.lit(0.0))),
        "longest_segment_seconds": seconds(zero("longest")), "first_speech_seconds": F.coalesce(seconds(F.col("first")), F.lit(-1.0)), "threshold_dbfs": 10.0 * F.log10("threshold"), "frames": F.col("frames"),
    })


ANALYZERS = {
    "duration_rms": duration_rms, "silence_ratio": silence_ratio, "clipping_detect": clipping, "zero_crossing_rate": zero_crossing_rate,
    "snr_estimate": snr_estimate, "spectral_centroid": spectral_centroid, "spectral_rolloff": spectral_rolloff, "energy_vad": energy_vad,
}

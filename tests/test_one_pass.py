"""Analyzers against plain numpy on random recordings, cut into blocks; and their plans: one pass over the samples."""

import math
import re

import numpy as np
import pytest

from callmetrics.operators import analyzers as A
from callmetrics.operators.signals import blocked

RATE, FRAME = 8000, 160


def signals():
    rng = np.random.default_rng(9)
    out = {"none": np.zeros(0), "one": np.ones(1), "two": np.array([0.5, -0.5]), "odd": rng.uniform(-1, 1, 81), "frame": rng.uniform(-1, 1, FRAME), "quiet": rng.normal(0, 1e-4, 3333), "zero": np.zeros(2500), "full": np.ones(1600)}
    for i in range(14):
        parts = [rng.normal(0, rng.choice([1e-5, 1e-3, 0.3]), rng.integers(100, 1500)) for _ in range(rng.integers(2, 14))]
        out[f"r{i}"] = np.clip(np.concatenate(parts) * rng.choice([1, 4]), -1, 1)
    return {k: np.asarray(v, np.float32).astype(np.float64) for k, v in out.items()}


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(k, RATE, [float(x) for x in v]) for k, v in signals().items()]
    return blocked(spark.createDataFrame(rows, "call_id string, sample_rate int, samples array<float>"), 1280).repartition(5).cache()


def runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i - start))
            start = None
    return out


def powers(x):
    return (x[: len(x) // FRAME * FRAME].reshape(-1, FRAME) ** 2).mean(axis=1)


def check(got, want):
    assert set(got) == set(signals())
    for call, x in signals().items():
        expected = want(x)
        row = got[call]
        if expected is None:
            assert row["status"] == "SKIPPED", call
            continue
        assert row["status"] == "SUCCESS", call
        for k, v in expected.items():
            assert row[k] == pytest.approx(v, rel=1e-6, abs=1e-9), (call, k)


def by_call(df):
    return {r["call_id"]: r.asDict() for r in df.collect()}


def test_silence(blocks):
    def want(x):
        if not len(x):
            return None
        q = np.sqrt(powers(x)) < 10 ** (-50 / 20)
        r, n, s = runs(q), len(q), FRAME / RATE
        loud = np.flatnonzero(~q)
        return {"silence_ratio": q.mean() if n else 0.0, "silent_seconds": q.sum() * s, "longest_silence_seconds": max([k for _, k in r], default=0) * s, "leading_silence_seconds": (loud[0] if len(loud) else n) * s, "trailing_silence_seconds": (n - 1 - loud[-1] if len(loud) else n) * s, "frames": n}

    check(by_call(A.silence_ratio(blocks, FRAME)), want)


def test_clipping(blocks):
    def want(x):
        if not len(x):
            return None
        r = [k for _, k in runs(np.abs(x) >= 0.999)]
        long = [k for k in r if k >= 3]
        return {"clipped": bool(long), "clipped_sample_ratio": sum(long) / len(x), "clip_events": len(long), "longest_clip_samples": max(long, default=0), "full_scale_samples": sum(r), "peak": np.abs(x).max()}

    check(by_call(A.clipping(blocks)), want)


def test_crossings(blocks):
    def want(x):
        if len(x) < 2:
            return None
        size = FRAME if len(x) >= FRAME else len(x) // 2 * 2
        f = x[: len(x) // size * size].reshape(-1, size) if len(x) >= FRAME else x[None, :size]
        rate = (np.diff(np.signbit(f), axis=1)).sum(axis=1) / (size / RATE)
        voiced = np.sqrt((f**2).mean(axis=1)) >= 10 ** (-50 / 20)
        return {"zcr_per_second": rate.mean(), "zcr_std": rate.std(), "voiced_zcr_per_second": rate[voiced].mean() if voiced.any() else 0.0, "voiced_frame_ratio": voiced.mean(), "frames": len(f)}

    check(by_call(A.zero_crossing_rate(blocks, FRAME)), want)


def speech(x):
    p = powers(x)
    noise = np.percentile(p, 10)
    limit = 1e-5 if noise <= 0 else noise * 10**1.2
    on = p > limit
    for start, k in runs(~on):
        if k <= 15 and start > 0 and start + k < len(on):
            on[start : start + k] = True
    return p, limit, [(a, k) for a, k in runs(on) if k >= 10]


def test_speech(blocks):
    def want(x):
        if len(x) // FRAME < 10:
            return None
        p, limit, s = speech(x)
        k = [n for _, n in s]
        return {"speech_ratio": sum(k) / len(p), "segments": len(k), "mean_segment_seconds": np.mean(k) * FRAME / RATE if k else 0.0, "longest_segment_seconds": max(k, default=0) * FRAME / RATE, "first_speech_seconds": s[0][0] * FRAME / RATE if s else -1.0, "threshold_dbfs": 10 * math.log10(limit), "frames": len(p)}

    check(by_call(A.energy_vad(blocks, FRAME)), want)
    got = sorted((r["call_id"], r["start"], r["length"]) for r in A.speech_segments(blocks, FRAME).collect())
    assert got == sorted((c, a, k) for c, x in signals().items() if len(x) >= FRAME for a, k in speech(x)[2])


def test_spectra(blocks):
    def frames(x):
        f = np.stack([x[i : i + 512] for i in range(0, len(x) - 511, 256)])
        s = np.abs(np.fft.rfft(f * np.hanning(512), axis=1))
        return s, np.sqrt((f**2).mean(axis=1)) >= 10 ** (-50 / 20), np.arange(257) * RATE / 512

    def centroid(x):
        if len(x) < 512:
            return None
        s, loud, hz = frames(x)
        keep = loud & (s.sum(axis=1) > 0)
        c = (s[keep] * hz).sum(axis=1) / s[keep].sum(axis=1)
        return {"centroid_hz": c.mean() if len(c) else 0.0, "centroid_std_hz": c.std() if len(c) else 0.0, "centroid_p90_hz": np.percentile(c, 90) if len(c) else 0.0, "measured_frames": len(c), "frames": len(s)}

    def rolloff(x):
        if len(x) < 512 or not frames(x)[1].any():
            return None
        s, loud, hz = frames(x)
        s = s[loud]
        r = hz[(np.cumsum(s, axis=1) >= 0.85 * s.sum(axis=1)[:, None]).argmax(axis=1)]
        p = s**2 + 1e-10
        return {"rolloff_hz": r.mean(), "rolloff_p90_hz": np.percentile(r, 90), "flatness": (np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1)).mean(), "measured_frames": len(s), "frames": len(loud)}

    check(by_call(A.spectral_centroid(blocks)), centroid)
    check(by_call(A.spectral_rolloff(blocks)), rolloff)


def test_samples_are_read_once(spark, tmp_path):
    """Each plan has one scan, one Python node and one shuffle, and no row is made of a frame's samples."""
    rows = [("a", RATE, [0.1] * 2000)]
    blocked(spark.createDataFrame(rows, "call_id string, sample_rate int, samples array<float>"), 800).write.parquet(f"{tmp_path}/b")
    for name, analyze in A.ANALYZERS.items():
        plan = analyze(spark.read.parquet(f"{tmp_path}/b"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and len(re.findall(r"Exchange hash", plan)) == 1 and plan.count("Generate") == 0, name
        assert len(re.findall(r"MapInArrow|MapInPandas", plan)) == (0 if name == "duration_rms" else 1), name

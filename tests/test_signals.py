"""Measurements of known signals against numpy."""

import math

import numpy as np
import pytest

from callmetrics.operators import analyzers as A
from callmetrics.operators.signals import blocked, bridged, frames, hops, runs

RATE = 16000


def recordings(spark, block=3200, **signals):
    rows = [(name, RATE, [float(v) for v in np.asarray(x, np.float32)]) for name, x in signals.items()]
    return blocked(spark.createDataFrame(rows, "call_id string, sample_rate int, samples array<float>"), block)


def by_call(df):
    return {r["call_id"]: r.asDict() for r in df.collect()}


def tone(hz, seconds, level=1.0):
    return level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def test_level_of_known_signals(spark):
    b = recordings(spark, sine=tone(440, 1), half=np.full(1000, 0.5), square=np.tile([1.0, -1.0], 500), zero=np.zeros(8000), none=[])
    r = by_call(A.duration_rms(b))
    assert r["sine"]["rms"] == pytest.approx(1 / math.sqrt(2), abs=1e-3)
    assert r["half"]["dbfs"] == pytest.approx(-6.02, abs=0.01)
    assert r["square"]["rms"] == pytest.approx(1.0)
    assert (r["zero"]["dbfs"], r["zero"]["duration_seconds"]) == (-120.0, 0.5)
    assert r["none"]["status"] == "SKIPPED" and r["none"]["rms"] is None


def test_claimed_duration_is_kept_beside_the_measured(spark):
    b = recordings(spark, zero=np.zeros(8000))
    claim = spark.createDataFrame([("zero", 999.0)], "call_id string, duration_seconds double")
    r = by_call(A.duration_rms(b, claim))["zero"]
    assert (r["duration_seconds"], r["reference_duration_seconds"]) == (0.5, 999.0)


def test_silence_contract(spark):
    b = recordings(spark, zero=np.zeros(RATE), mixed=np.concatenate([np.zeros(3200), tone(300, 0.5), np.zeros(1600)]))
    r = by_call(A.silence_ratio(b))
    assert (r["zero"]["silence_ratio"], r["zero"]["longest_silence_seconds"], r["zero"]["leading_silence_seconds"], r["zero"]["trailing_silence_seconds"]) == (1.0, 1.0, 1.0, 1.0)
    assert (r["mixed"]["leading_silence_seconds"], r["mixed"]["trailing_silence_seconds"]) == (0.2, 0.1)
    assert by_call(A.clipping(b))["zero"]["clipped"] is False
    assert by_call(A.snr_estimate(b))["zero"]["status"] == "SKIPPED"
    assert by_call(A.spectral_centroid(b))["zero"]["centroid_hz"] == 0.0
    assert by_call(A.spectral_rolloff(b))["zero"]["status"] == "SKIPPED"
    v = by_call(A.energy_vad(b))["zero"]
    assert (v["segments"], v["first_speech_seconds"]) == (0, -1.0) and v["threshold_dbfs"] == pytest.approx(-50)
    assert by_call(A.zero_crossing_rate(b))["zero"]["voiced_frame_ratio"] == 0.0


def test_clipping_counts_runs_across_blocks(spark):
    x = np.zeros(6400)
    x[3198:3204] = 1.0  # spans two blocks
    x[10:12] = -1.0  # too short
    r = by_call(A.clipping(recordings(spark, c=x)))["c"]
    assert (r["clip_events"], r["longest_clip_samples"], r["full_scale_samples"], r["clipped"]) == (1, 6, 8, True)


def test_tone_has_its_frequency(spark):
    b = recordings(spark, t=tone(440, 2, 0.7))
    assert by_call(A.zero_crossing_rate(b))["t"]["zcr_per_second"] == pytest.approx(880, rel=0.05)
    assert by_call(A.spectral_centroid(b))["t"]["centroid_hz"] == pytest.approx(440, rel=0.15)
    assert by_call(A.spectral_rolloff(b))["t"]["band_limited"] is True


@pytest.mark.parametrize("n", [0, 1, 319, 320, 321, 511, 512, 513, 3199, 3200, 3201, 7000])
def test_frames_and_hops_at_edges(spark, n):
    x = np.random.default_rng(n).standard_normal(n).astype(np.float32)
    b = recordings(spark, block=640 * 4, c=x)
    assert frames(b, 320).count() == n // 320
    got = {r["frame_idx"]: np.array(r["frame"], np.float32) for r in hops(b, 512, 256).collect()}
    want = {i: x[i * 256 : i * 256 + 512] for i in range((n - 512) // 256 + 1)} if n >= 512 else {}
    assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want)


def test_short_calls_are_skipped_or_one_frame(spark):
    b = recordings(spark, one=[0.1], few=np.tile([0.5, -0.5], 50), odd=np.tile([0.5, -0.5, 0.5], 7))
    r = by_call(A.zero_crossing_rate(b))
    assert r["one"]["status"] == "SKIPPED" and r["few"]["frames"] == 1
    assert r["few"]["zcr_per_second"] == pytest.approx(99 / (100 / RATE))
    assert by_call(A.spectral_centroid(b))["few"]["status"] == "SKIPPED"


def test_default_blocks_hold_whole_frames(spark):
    x = tone(300, 9)  # three blocks
    rows = [("c", RATE, [float(v) for v in x.astype(np.float32)])]
    b = blocked(spark.createDataFrame(rows, "call_id string, sample_rate int, samples array<float>"))
    assert b.count() == 3 and frames(b, 320).count() == len(x) // 320 and hops(b, 512, 256).count() == (len(x) - 512) // 256 + 1


def test_runs_and_bridges(spark):
    rows = spark.createDataFrame([("a", i) for i in (0, 1, 2, 5, 6, 20)], "call_id string, idx long")
    assert sorted((r["start"], r["length"]) for r in runs(rows, ["call_id"]).collect()) == [(0, 3), (5, 2), (20, 1)]
    assert sorted((r["start"], r["length"]) for r in bridged(rows, ["call_id"], 2).collect()) == [(0, 7), (20, 1)]


def test_speech_in_gated_noise(spark):
    rng = np.random.default_rng(1)
    t = np.arange(RATE * 10) / RATE
    x = 0.4 * rng.uniform(-1, 1, len(t)) * (np.sin(2 * np.pi * 0.7 * t) > 0) + 1e-4 * rng.standard_normal(len(t))
    v = by_call(A.energy_vad(recordings(spark, block=320 * 50, g=x)))["g"]
    assert 1 < v["segments"] < 60 and 0.2 < v["speech_ratio"] < 0.9

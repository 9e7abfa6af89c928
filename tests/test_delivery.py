"""Results, retries, dead letters, codecs, streams."""

import json
import tempfile
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from callmetrics import functions as L
from callmetrics import streaming as S
from callmetrics.operators import accounting as C
from callmetrics.operators import delivery as V
from callmetrics.operators.python_analyzer import AnalyzerError, from_python, validate
from callmetrics.sources import events as E
from callmetrics.sources import records as R


def test_poison_records(spark):
    good = ['{"call_id":"c1","audio_id":"a","ingested_at":"2026-01-01T00:00:00+00:00","tenant":{"a":[1,2]}}', '{"call_id":"c2","audio_id":"a"}']
    bad = ["{not json", "[]", '{"audio_id":"a"}', '{"call_id":"c"}', '{"call_id":"","audio_id":"a"}', '{"call_id":"c","audio_id":""}', '{"call_id":"c","audio_id":"a","ingested_at":"soon"}', '{"call_id":123,"audio_id":"a"}', '[{"call_id":"c","audio_id":"a"}]', ""]
    df = spark.createDataFrame([(x.encode(),) for x in good + bad] + [(None,)], "raw binary")
    rows = R.decoded(df).collect()
    assert [r["error_code"] for r in rows] == [None] * 2 + ["DECODE_ERROR"] * (len(bad) + 1)
    assert rows[0]["call_id"] == "c1" and rows[0]["ingested_at"] == datetime(2026, 1, 1) and rows[1]["ingested_at"] is None


def flac(rate=16000, channels=1, bits=16, total=4_800_000, kind=0x80, size=34):
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total
    return b"fLaC" + bytes([kind]) + size.to_bytes(3, "big") + bytes(10) + packed.to_bytes(8, "big") + bytes(48)


def test_headers_and_gate(spark):
    cases = {"ok": flac(), "wide": flac(44100, 2, 24), "unknown": flac(total=0), "huge": flac(total=2**36 - 1), "empty": b"", "wav": b"RIFF....WAVE", "magic": b"fLaC", "cut": flac()[:20], "type": flac(kind=0x84), "size": flac(size=33)}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [("null", None)], "id string, content binary")
    r = {x["id"]: x for x in R.canonical_gate(df.withColumns(R.streaminfo())).collect()}
    assert (r["ok"]["error_code"], r["ok"]["duration_seconds"]) == (None, 300.0)
    assert (r["wide"]["error_code"], r["wide"]["sample_rate"], r["wide"]["channels"], r["wide"]["bits_per_sample"]) == ("AUDIO_NOT_CANONICAL", 44100, 2, 24)
    assert r["unknown"]["error_code"] == "AUDIO_NO_DURATION" and r["huge"]["total_samples"] == 2**36 - 1
    assert all(r[k]["error_code"] == "AUDIO_NOT_FLAC" for k in ("empty", "wav", "magic", "cut", "type", "size", "null"))


def test_wav_blocks(spark):
    pcm = (np.arange(-50, 50) * 300).astype("<i2").tobytes()
    head = lambda rate, ch: b"RIFF" + (36 + len(pcm)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + ch.to_bytes(2, "little") + rate.to_bytes(4, "little") + (rate * 2).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + len(pcm).to_bytes(4, "little") + pcm
    df = spark.createDataFrame([("ok", head(16000, 1), 16000), ("rate", head(8000, 1), 16000), ("two", head(16000, 2), 16000), ("bad", b"<html>", 16000), ("null", None, 16000)], "call_id string, content binary, sample_rate int")
    rows = R.wav_blocks(df, 40).collect()
    ok = sorted((r for r in rows if r["call_id"] == "ok"), key=lambda r: r["start_sample"])
    assert [r["start_sample"] for r in ok] == [0, 40, 80] and ok[0]["samples"][0] == np.float32(-15000 / 32768)
    assert {r["call_id"]: r["error_code"] for r in rows} == {"ok": None, "rate": "SAMPLE_RATE_MISMATCH", "two": "CHANNEL_MISMATCH", "bad": "DECODE_ERROR", "null": "DECODE_ERROR"}


def test_python_analyzer_never_raises(spark):
    def factory():
        def process(ref, x):
            if ref["call_id"] == "skip":
                return None
            if ref["call_id"] == "known":
                raise AnalyzerError("MODEL_BUSY", "later", True)
            return {"n": len(x)} if ref["call_id"] == "ok" else 1 / 0 if ref["call_id"] == "raise" else [1]

        return process

    validate("f", "1", factory)
    df = spark.createDataFrame([(c, 16000, [0.0, 1.0]) for c in ("ok", "skip", "known", "raise", "list")], "call_id string, sample_rate int, samples array<float>")
    r = {x["call_id"]: x for x in from_python(factory)(df).collect()}
    assert json.loads(r["ok"]["payload"]) == {"n": 2} and r["skip"]["status"] == "SKIPPED"
    assert [(r[k]["error"]["code"], r[k]["error"]["retryable"]) for k in ("known", "raise", "list")] == [("MODEL_BUSY", True), ("UNHANDLED", True), ("BAD_RETURN", False)]


def test_functions(spark):
    import hashlib

    row = spark.range(1).select(L.hash_bucket(F.lit("c1")).alias("h"), L.backoff_seconds(F.lit(9), F.lit(2.0), F.lit(300.0)).alias("b"), F.length(L.truncated_bytes(F.lit("é" * 600))).alias("t"), L.split_group(F.lit("a:b:c"))[1].alias("v"), L.int_or(F.lit("x")).alias("i")).first()
    assert row["h"] == int.from_bytes(hashlib.sha256(b"c1").digest()[:8], "big") / 2**64
    assert (row["b"], row["t"], row["v"], row["i"]) == (300.0, 512, "b:c", -1)


def test_declarations(spark):
    good, bad = E.declarations(spark, [{"function_id": "a", "function_version": "1", "image": "i"}, {"function_id": "b"}, {"function_id": "c", "function_version": "1", "image": "i", "odd": 1}, {"function_id": "d", "function_version": "1", "image": "i", "in_flight": 0}])
    assert good.first()["dlq_topic"] == "calls.dlq.a" and good.count() == 1 and {r["function_id"] for r in bad.collect()} == {"b", "c", "d"}


def test_claim_check_and_validity(spark):
    schema = "call_id string, function_id string, function_version string, status string, payload string, payload_ref string"
    df = spark.createDataFrame([("a", "f", "1", "SUCCESS", "x" * 10, None), ("b", "f", "1", "SUCCESS", "x" * 9, None), ("c", "f", "1", "FAILED", "x", None), ("d", "f", "1", "SUCCESS", "", None)], schema)
    r = {x["call_id"]: x for x in V.claim_checked(df, 10).collect()}
    assert r["a"]["payload_ref"] == "results/f/1/a" and r["a"]["payload"] is None and r["b"]["payload"] == "x" * 9
    assert r["c"]["payload"] is None and r["d"]["payload"] is None and r["d"]["payload_ref"] is None
    odd = spark.createDataFrame([("SUCCESS", "p", None), ("SUCCESS", "p", "r"), (None, "p", None), ("UNSPECIFIED", None, None)], "status string, payload string, payload_ref string")
    assert [x["ok"] for x in odd.select(V.valid_result().alias("ok")).collect()] == [True, False, False, False]


def test_lag_in_time(spark):
    df = spark.createDataFrame([(10, 2.0), (10, 0.0), (0, 0.0)], "lag long, rate double")
    a, b, c = (r["s"] for r in df.select(C.lag_seconds(F.col("lag"), F.col("rate")).alias("s")).collect())
    assert a == 5.0 and b == float("inf") and c != c


def test_chain_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "upstream string, downstream string")
    assert {r["function_id"]: r["depth"] for r in S.chain_depth(edges).collect()} == {"a": 1, "b": 2, "c": 3}


def test_completeness_stream(spark):
    folder = tempfile.mkdtemp()
    at = lambda m: datetime(2026, 1, 1, 0, m)
    batches = [[("c1", "f1", "SUCCESS", at(0)), ("c2", "f1", "FAILED", at(0)), ("c3", "x", "UNHYDRATED", at(0))], [("c1", "f2", "SKIPPED", at(1)), ("c1", "f2", "SKIPPED", at(1))], [("c4", "f1", "SUCCESS", at(50))], [("c4", "f2", "SUCCESS", at(51))], [("c5", "f1", "SUCCESS", at(52))]]
    schema = "call_id string, function_id string, status string, at timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    writer = S.completeness(stream, ["f1", "f2"], timeout_seconds=600, late="1 minute").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
    S.run_available(writer)
    got = {r["call_id"]: (r["marker"], r["missing"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got["c1"] == ("complete", "") and got["c2"] == ("timeout", "f2") and got["c3"][0] == "unhydrated" and got["c4"] == ("complete", "")


def test_hydration_stream(spark):
    folder = tempfile.mkdtemp()
    rows = [(b'{"call_id":"c1","audio_id":"a1"}',), (b'{"call_id":"c2","audio_id":"gone"}',), (b'{"call_id":"c3","audio_id":"a2"}',), (b"junk",)]
    spark.createDataFrame(rows, "raw binary").write.parquet(f"{folder}/in")
    recordings = spark.createDataFrame([("a1", flac()), ("a2", flac(44100))], "audio_id string, content binary")
    S.run_available(S.hydration(S.file_messages(spark, f"{folder}/in", "raw binary"), recordings, f"{folder}/out", f"{folder}/cp"))
    assert [(r["call_id"], r["object_key"], r["duration_seconds"]) for r in spark.read.parquet(f"{folder}/out/references").collect()] == [("c1", "c1.flac", 300.0)]
    assert {r["error_code"] for r in spark.read.parquet(f"{folder}/out/hydration_failures").collect()} == {"AUDIO_NOT_FOUND", "AUDIO_NOT_CANONICAL", "DECODE_ERROR"}
    assert spark.read.parquet(f"{folder}/out/objects").count() == 1

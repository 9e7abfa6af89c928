"""Streams: replayed batches, retries, tails, progress; erasure, poison, codec, ad-hoc runs."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from callmetrics import streaming as S
from callmetrics.operators import accounting as C
from callmetrics.operators import delivery as V
from callmetrics.operators import fleet as T
from callmetrics.operators.python_analyzer import ad_hoc, from_python
from callmetrics.sources import events as E

ERROR = "error struct<code:string,message:string,retryable:boolean>"
OUTCOMES = (
    f"call_id string, function_id string, function_version string, status string, {ERROR}, payload string, payload_ref string, input_object_key string, attempt int, retry_budget int, "
    "retry_backoff_seconds double, retry_backoff_max_seconds double, key binary, body binary, source_topic string, source_partition int, source_offset long, failed_at timestamp"
)
NOW = datetime(2026, 1, 1)


def outcome(call, status, attempt=1, retryable=True, payload=None):
    error = None if status != "FAILED" else ("BUSY", "later", retryable)
    return (call, "f", "1", status, error, payload, None, f"{call}.flac", attempt, 3, 2.0, 5.0, call.encode(), b"{}", "calls.internal", 0, 7, NOW)


def contents(spark, path):
    return sorted(map(str, spark.read.parquet(path).drop("batch", "of").collect()))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rows = [outcome("a", "SUCCESS", payload="{}"), outcome("b", "FAILED"), outcome("c", "FAILED", retryable=False), outcome("d", "FAILED", 3), outcome("e", "SKIPPED"), outcome("g", "SUCCESS", payload="x" * 300_000)]
    batch, out = spark.createDataFrame(rows, OUTCOMES), f"{tmp_path}/out"
    batch.write.parquet(f"{tmp_path}/in")
    S.run_available(S.analysis(S.file_messages(spark, f"{tmp_path}/in", OUTCOMES), out, f"{tmp_path}/cp", "f", "1"))
    tables = ("results", "retry_queue", "dead_letters", "large_payloads")
    before = {t: contents(spark, f"{out}/{t}") for t in tables}
    S._route(batch, 0, out, "f-1")
    assert before == {t: contents(spark, f"{out}/{t}") for t in tables}
    results = {r["call_id"]: r for r in spark.read.parquet(f"{out}/results").collect()}
    assert set(results) == {"a", "c", "d", "e", "g"} and results["a"]["result_key"] == "a:f:1" and results["g"]["payload_ref"] == "results/f/1/g" and results["c"]["status"] == "FAILED"
    assert {r["call_id"] for r in spark.read.parquet(f"{out}/dead_letters").collect()} == {"c", "d"} and spark.read.parquet(f"{out}/retry_queue").first()["attempt"] == 2


def analyzer(failed_at):
    """Outcomes: `never` always fails, `twice` at its first attempt."""

    def analyze(references):
        bad = (F.col("call_id") == "never") | ((F.col("call_id") == "twice") & (F.col("attempt") < 2))
        null = lambda kind: F.lit(None).cast(kind)
        error = F.when(bad, F.struct(F.lit("BUSY").alias("code"), F.lit("later").alias("message"), F.lit(True).alias("retryable")))
        return references.select(
            "call_id", F.lit("f").alias("function_id"), F.lit("1").alias("function_version"), F.when(bad, "FAILED").otherwise("SUCCESS").alias("status"), error.alias("error"), F.hex("body").alias("payload"), null("string").alias("payload_ref"),
            F.concat("call_id", F.lit(".flac")).alias("input_object_key"), "attempt", F.lit(3).alias("retry_budget"), F.lit(2.0).alias("retry_backoff_seconds"), F.lit(5.0).alias("retry_backoff_max_seconds"), null("binary").alias("key"), "body",
            null("string").alias("source_topic"), null("int").alias("source_partition"), null("long").alias("source_offset"), failed_at.alias("failed_at"),
        )

    return analyze


REFERENCE = "call_id string, body binary"


def state(spark, checkpoint, variable):
    """What a stateful query keeps under a name."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).collect()


def run_until(writers, look, good, rows=0, seconds=60):
    """Runs streams side by side until what they have written is good, and `rows` rows were read by the first; whether it was so in time."""
    queries = [w.trigger(processingTime="300 milliseconds").start() for w in writers]
    try:
        end = time.time() + seconds
        while time.time() < end:
            time.sleep(0.5)
            for q in queries:
                assert q.isActive, q.exception()
            try:
                found = look()
            except AnalysisException:  # nothing is written yet
                continue
            if good(found) and sum(p.numInputRows for p in queries[0].recentProgress) >= rows:
                return True
        return False
    finally:
        for q in queries:
            q.stop()


def test_retries_run_once_their_time_has_come(spark, tmp_path):
    for i, calls in enumerate((["ok", "twice", "never"], ["x"])):
        spark.createDataFrame([(c, b"\x00\xff") for c in calls], REFERENCE).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(REFERENCE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    results = lambda: {(r["call_id"], r["status"], r["attempt"], r["payload"]) for r in spark.read.parquet(f"{tmp_path}/out/results").collect()}
    want = {("ok", "SUCCESS", 1, "00FF"), ("twice", "SUCCESS", 2, "00FF"), ("never", "FAILED", 3, None), ("x", "SUCCESS", 1, "00FF")}
    assert run_until(S.retry_loop(stream, analyzer(F.lit(NOW)), f"{tmp_path}/out", f"{tmp_path}/cp", "f", "1"), results, lambda found: found == want)
    assert [r["call_id"] for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()] == ["never"]
    assert state(spark, f"{tmp_path}/cp/f/1-retries", "waiting") == []  # finished calls are gone


def test_a_retry_fires_without_input(spark, tmp_path):
    """The streams run on while nothing arrives; a retry comes when its time has come, and no sooner."""
    spark.createDataFrame([("twice", b"1")], REFERENCE).write.parquet(f"{tmp_path}/in")
    writers = S.retry_loop(S.file_messages(spark, f"{tmp_path}/in", REFERENCE), analyzer(F.current_timestamp()), f"{tmp_path}/out", f"{tmp_path}/cp", "f", "1")
    attempts = lambda: [r["attempt"] for r in spark.read.parquet(f"{tmp_path}/out/results").collect()]
    assert run_until(writers, attempts, lambda found: found == [2])
    waited = spark.read.parquet(f"{tmp_path}/out/retry_queue").select("due_at").first()[0]
    assert max((p for p in (tmp_path / "out" / "retries_due" / "of=f-1").glob("*.parquet")), key=lambda p: p.stat().st_mtime).stat().st_mtime >= waited.timestamp() - 0.01


def test_a_queue_that_is_written_again_wakes_nobody_twice(spark, tmp_path):
    schema = "call_id string, attempt int, due_at timestamp, reference string"
    rows = [("a", 2, NOW, "{}"), ("a", 3, datetime(2999, 1, 1), "{}"), ("b", 2, NOW, "{}")]
    for i in range(2):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    writer = S.due_retries(stream).writeStream.format("parquet").option("path", f"{tmp_path}/due").option("checkpointLocation", f"{tmp_path}/cp")
    due = lambda: sorted((r["call_id"], r["attempt"]) for r in spark.read.parquet(f"{tmp_path}/due").collect())
    assert run_until([writer], due, lambda found: found == [("a", 2), ("b", 2)], rows=6)
    assert due() == [("a", 2), ("b", 2)]
    assert len(state(spark, f"{tmp_path}/cp", "waiting")) == 1  # the one of the year 2999


ANSWERS = "call_id string, function_id string, status string, at timestamp"


def markers(spark, tmp_path, batches, **options):
    """Markers of answers that arrive batch by batch: (call, marker, answered, missing)."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    found = S.completeness(stream, ["a", "b"], **options)
    S.run_available(found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def at(minutes):
    return NOW + timedelta(minutes=minutes)


def test_a_call_of_the_first_batch_has_its_time(spark, tmp_path):
    """The watermark is 0 in the first batch; an answer two batches later is still in time."""
    batches = [[("c1", "a", "SUCCESS", at(0)), ("c2", "a", "SUCCESS", at(0))], [("c3", "a", "SUCCESS", at(20))], [("c1", "b", "FAILED", at(30))], [("z", "a", "SUCCESS", at(200))], [("z", "b", "SUCCESS", at(201))]]
    got = markers(spark, tmp_path, batches, timeout_seconds=3600)
    assert got == [("c1", "complete", 2, ""), ("c2", "timeout", 1, "b"), ("c3", "timeout", 1, "b"), ("z", "complete", 2, "")]


def test_state_of_closed_calls_ends(spark, tmp_path):
    """Answers go with the marker, the memory of it after a while; until then late answers change nothing."""
    batches = [[("c1", "a", "SUCCESS", at(0)), ("c1", "b", "SUCCESS", at(0)), ("u", "a", "UNHYDRATED", at(0)), ("n", "a", "SUCCESS", None)], [("c1", "a", "SUCCESS", at(5)), ("y", "a", "SUCCESS", at(30))], [("z", "a", "SUCCESS", at(500)), ("z", "b", "SUCCESS", at(500))], [("w", "a", "SUCCESS", at(505))]]
    got = markers(spark, tmp_path, batches, timeout_seconds=600, keep_seconds=7200)
    assert got == [("c1", "complete", 2, ""), ("u", "unhydrated", 0, "a,b"), ("y", "timeout", 1, "b"), ("z", "complete", 2, "")]
    assert {r["key"]["call_id"] for r in state(spark, f"{tmp_path}/cp", "done")} == {"z", "y"} and {r["key"]["call_id"] for r in state(spark, f"{tmp_path}/cp", "answers")} == {"w"}


def test_retries_wait_until_they_are_due(spark):
    queue = S.retry_rows(spark.createDataFrame([outcome("a", "FAILED"), outcome("b", "FAILED", 2)], OUTCOMES))
    assert [r["call_id"] for r in S.due(queue, F.lit(NOW + timedelta(seconds=3))).collect()] == ["a"]


def test_live_tail(spark, tmp_path):
    schema = "event_name string, call_id string, at timestamp"
    names = ["call.received", "call.completed", "call.dead_lettered", "call.failed", "call.completed"]
    spark.createDataFrame([(n, f"c{i}", NOW + timedelta(minutes=i)) for i, n in enumerate(names)], schema).write.parquet(f"{tmp_path}/in")
    S.run_available(S.live_tail(S.file_messages(spark, f"{tmp_path}/in", schema), f"{tmp_path}/tail", f"{tmp_path}/cp", F.lit(NOW + timedelta(minutes=1))))
    assert [r["call_id"] for r in S.newest(spark.read.parquet(f"{tmp_path}/tail"), 5).collect()] == ["c4", "c2"]


def test_deduplicated_and_windowed_streams(spark, tmp_path):
    schema = "call_id string, function_id string, function_version string, event_name string, completed_at timestamp, at timestamp"
    rows = [("a", "f", "1", "done", NOW, NOW), ("a", "f", "1", "done", NOW + timedelta(minutes=1), NOW), ("a", "f", "2", "done", NOW, NOW), ("z", "f", "1", "done", NOW + timedelta(days=9), NOW + timedelta(days=9))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = lambda: S.file_messages(spark, f"{tmp_path}/in", schema)
    to = lambda df, name: S.run_available(df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}"))
    to(S.deduplicated(stream()), "once")
    assert sorted((r["call_id"], r["function_version"]) for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [("a", "1"), ("a", "2"), ("z", "1")]
    to(S.windowed_rates(stream(), "5 minutes", None), "rates")
    assert [(r["window_start"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/rates").collect()] == [(NOW, 3)]


def test_backfill_is_repeatable(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        S.backfill(spark, f"{tmp_path}/in", "id long", lambda df: df.withColumn("twice", F.col("id") * 2), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r["twice"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8]


def test_keyed_table_keeps_the_last(spark, tmp_path):
    for i, rows in enumerate(([("k", 1)], [("k", 2), ("l", 1)], [("k", 2), ("l", 1)])):
        S.overwrite_latest(spark.createDataFrame(rows, "key string, n int"), min(i, 1), f"{tmp_path}/t", ["key"], ["n"])
    there = spark.read.parquet(f"{tmp_path}/t")
    assert there.count() == 3 and sorted((r["key"], r["n"]) for r in V.latest(there, ["key"], ["batch"]).collect()) == [("k", 2), ("l", 1)]


def test_lag_from_progress(spark):
    report = lambda i, done: json.dumps({"batchId": i, "sources": [{"endOffset": json.dumps({"t": {"0": done, "1": 5}}), "latestOffset": json.dumps({"t": {"0": 10, "1": 5, "2": 4}})}]})
    df = spark.createDataFrame([("g", report(1, 3)), ("g", report(2, 8)), ("h", report(1, 10))], "group_id string, json string")
    assert {r["group_id"]: (r["lag"], r["uncommitted"]) for r in C.group_lag(T.progress_offsets(df)).collect()} == {"g": (6, 1), "h": (4, 1)}


def test_cycles_are_not_allowed(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "upstream string, downstream string")
    assert {r["function_id"]: (r["depth"], r["allowed"]) for r in S.chain_depth(edges).collect()} == {"a": (None, False), "b": (None, False), "c": (None, False), "x": (1, True), "y": (2, True)}
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(7)], "upstream string, downstream string")
    assert {r["function_id"] for r in S.chain_depth(long).filter("allowed").collect()} == {f"n{i}" for i in range(5)}


def test_erased_calls_leave_their_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", 1), ("b", "f", 2), ("b", "g", 3), ("c", "h", 4)], "call_id string, function_id string, n int")
    got = V.compacted(df, spark.createDataFrame([("b",)], "call_id string"), f"{tmp_path}/new", "function_id")
    assert [(r["call_id"], r["function_id"]) for r in got.collect()] == [("a", "f")]


def test_poison_and_keys(spark):
    schema = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers map<string,binary>"
    df = spark.createDataFrame([(k, b"junk", "calls.raw", 0, i, NOW, {"status": b"FAILED"} if i else None) for i, k in enumerate((b"c1", None, b"\xff\xfe"))], schema)
    failures = V.poisoned(df, "f", "1", F.lit("not JSON"))
    assert [r["call_id"] for r in V.failed_results(failures).collect()] == ["c1"] and V.dead_letter_rows(failures).count() == 3
    assert [(r[0], r[1]) for r in df.select(E.call_of_key(), E.header("status", "none")).collect()] == [("c1", "none"), ("", "FAILED"), ("", "FAILED")]


def test_result_codec(spark):
    bad = ["", "[]", "{}", '{"call_id":"c","function_id":"f","function_version":"1","status":"UNSPECIFIED"}', '{"call_id":"c","function_id":"f","function_version":"1","status":"SUCCESS","payload":"a","payload_ref":"b"}']
    good = '{"call_id":"c","function_id":"f","function_version":"1","status":"FAILED","error":{"code":"X","message":"m","retryable":true},"completed_at":"2026-01-01T00:00:00Z"}'
    rows = E.result_of_json(spark.createDataFrame([(x,) for x in [*bad, good]], "value string")).collect()
    assert [r["error_code"] for r in rows] == ["DECODE_ERROR"] * len(bad) + [None]
    assert rows[-1]["completed_at"] == NOW and rows[-1]["error"]["retryable"] and rows[-1]["envelope_version"] == 1


def test_ad_hoc_run(spark):
    df = spark.createDataFrame([("x", "a1", 16000, [0.0] * 32000), ("y", "a2", 16000, [0.0])], "call_id string, audio_id string, sample_rate int, samples array<float>")
    r = ad_hoc(from_python(lambda: lambda ref, x: {"n": len(x)}), df, "a1").collect()
    assert len(r) == 1 and json.loads(r[0]["payload"]) == {"n": 32000} and r[0]["audio_seconds"] == 2.0 and r[0]["multiple"] > 0


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"call_id": "c", "audio_id": "a", "expect": "hydrates", "filename": "a.flac", "seconds": 3.5}, {"call_id": "d", "audio_id": "b", "expect": "poison"}]}))
    assert [r["audio_id"] for r in T.usable_recordings(E.manifest(spark, str(tmp_path / "m.json"))).collect()] == ["a"]


def test_ranks_of_odd_values(spark):
    rows = [("a", v) for v in (3.0, 1.0, 2.0, 2.0, None, float("nan"), 1e9)] + [("b", 5.0), ("c", None)]
    got = {r["k"]: (r["p0"], r["p50"], r["p100"]) for r in T.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0, 50, 100]).collect()}
    assert got == {"a": (1.0, 2.0, 1e9), "b": (5.0, 5.0, 5.0)}
    q = {r["k"]: r["p25"] for r in T.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.25]).collect()}
    assert q["a"] == pytest.approx(2.0) and q["b"] == 5.0

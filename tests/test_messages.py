"""Declarations, payload bytes, poison and time limits in streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callmetrics import streaming as S
from callmetrics.schemas import MESSAGES
from callmetrics.sources import events as E

NOW = datetime(2026, 1, 1)


def test_declarations_as_users_write_them(spark):
    whole = {"function_id": "a", "function_version": 1.5, "image": "i", "resources": {"cpu": 1, "memory": "512Mi"}, "in_flight": 2, "per_file_timeout_seconds": 30, "poll_timeout_seconds": 0.5}
    bad = [{"function_id": "b"}, {"function_id": "c", "function_version": "1", "image": "i", "odd": 1}, {"function_id": "d", "function_version": "1", "image": "i", "in_flight": 0}, {"function_id": "e", "function_version": "1", "image": "i", "resources": {"disk": 1}}, {"function_id": "g", "function_version": "1", "image": "i", "resources": {"gpu": "many"}}, ["list"]]
    good, rejected = E.declarations(spark, [whole, {"function_id": "n", "function_version": "2", "image": "i", "resources": None}, *bad])
    rows = {r["function_id"]: r for r in good.collect()}
    assert set(rows) == {"a", "n"} and rows["a"]["function_version"] == "1.5" and tuple(rows["a"]["resources"]) == (1.0, "512Mi", None) and rows["a"]["per_file_timeout_seconds"] == 30.0
    assert rows["n"]["retry_budget"] == 3 and {r["function_id"] for r in rejected.collect()} == {"b", "c", "d", "e", "g", "None"}


def test_declaration_files(spark, tmp_path):
    texts = {"one": '{"function_id": "one", "function_version": "1.0.0", "image": "r/one:1", "resources": {"cpu": 0.5, "gpu": 1}}', "two": '{"function_id": "two"}', "torn": '{"function_id": [', "none": " \n"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "function.yaml").write_text(text)
    good, bad = E.declaration_files(spark, f"{tmp_path}/*/function.yaml")
    assert [(r["function_id"], r["resources"]["gpu"]) for r in good.collect()] == [("one", 1)]
    assert sorted(r["function_id"].rsplit("/", 2)[-2] if "/" in r["function_id"] else r["function_id"] for r in bad.collect()) == ["None", "torn", "two"]
    assert [x.count() for x in E.declaration_files(spark, f"{tmp_path}/nothing/*.yaml")] == [0, 0]


def test_payload_bytes(spark):
    """Any bytes come back as they were; what is not as the message says is told."""
    schema = "call_id string, function_id string, function_version string, status string, payload binary, payload_ref string"
    rows = [("all", "f", "1", "SUCCESS", bytes(range(256)), None), ("text", "f", "1", "SUCCESS", "é".encode(), None), ("none", "f", "1", "SKIPPED", None, None), ("empty", "f", "1", "SUCCESS", b"", None)]
    messages = E.result_json(spark.createDataFrame(rows, schema))
    back = {r["call_id"]: r for r in E.result_of_json(messages, payload="bytes").collect()}
    assert {c: r["payload"] and bytes(r["payload"]) for c, r in back.items()} == {"all": bytes(range(256)), "text": "é".encode(), "none": None, "empty": b""} and not any(r["error_code"] for r in back.values())
    text = {r["call_id"]: (r["payload"], r["error_code"]) for r in E.result_of_json(messages).collect()}
    assert text == {"all": (None, "DECODE_ERROR"), "text": ("é", None), "none": (None, None), "empty": ("", None)}
    plain = E.result_json(spark.createDataFrame([("p", "f", "1", "SUCCESS", '{"a": 1}', None)], schema.replace("binary", "string")))
    assert bytes(E.result_of_json(plain, payload="bytes").first()["payload"]) == b'{"a": 1}' and E.result_of_json(plain).first()["payload"] == '{"a": 1}'
    wrong = spark.createDataFrame([('{"call_id":"c","function_id":"f","function_version":"1","status":"SUCCESS","payload":"***","payload_encoding":"base64"}',)], "value string")
    assert [(r["payload"], r["error_code"]) for r in E.result_of_json(wrong, payload="bytes").collect()] == [(None, "DECODE_ERROR")]


def test_poison_reaches_dead_letters_and_results_and_limits_hold(spark, tmp_path):
    """A stream of messages: references, junk with a key and without, and one that takes too long."""
    values = [(b"a", b'{"call_id": "a"}'), (b"slow", b'{"call_id": "slow", "object_key": "o"}'), (b"keyed", b"junk \xff"), (None, b"[]"), (b"\xff\xfe", b'{"call_id": ""}')]
    rows = [("calls.internal", 0, i, bytearray(k) if k else None, bytearray(v), NOW, None) for i, (k, v) in enumerate(values)]
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(f"{tmp_path}/in")

    def analyze(references):
        null = lambda kind: F.lit(None).cast(kind)
        error = null("struct<code:string,message:string,retryable:boolean>")
        took = F.when(F.col("call_id") == "slow", 301).otherwise(1)
        return references.select(
            "call_id", F.lit("f").alias("function_id"), F.lit("1").alias("function_version"), F.lit("SUCCESS").alias("status"), error.alias("error"), F.lit("{}").alias("payload"), null("string").alias("payload_ref"), F.col("object_key").alias("input_object_key"), F.lit(3).alias("attempt"),
            F.lit(3).alias("retry_budget"), F.lit(2.0).alias("retry_backoff_seconds"), F.lit(5.0).alias("retry_backoff_max_seconds"), F.lit(300.0).alias("per_file_timeout_seconds"), F.lit(NOW).alias("started_at"), (F.lit(NOW) + F.make_dt_interval(secs=took)).alias("completed_at"),
            "key", F.col("value").alias("body"), F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.col("timestamp").alias("failed_at"),
        )

    S.run_available(S.message_analysis(S.file_messages(spark, f"{tmp_path}/in", MESSAGES), analyze, f"{tmp_path}/out", f"{tmp_path}/cp", "f", "1"))
    results = {(r["call_id"], r["status"], r["error"] and r["error"]["code"], r["input_object_key"]) for r in spark.read.parquet(f"{tmp_path}/out/results").collect()}
    assert results == {("a", "SUCCESS", None, "a.flac"), ("slow", "FAILED", "TIMEOUT", "slow.flac"), ("keyed", "FAILED", "DECODE_ERROR", "keyed.flac")}
    letters = {r["source_offset"]: (r["error_code"], bytes(r["body"])) for r in spark.read.parquet(f"{tmp_path}/out/dead_letters").collect()}
    assert letters == {1: ("TIMEOUT", values[1][1]), 2: ("DECODE_ERROR", b"junk \xff"), 3: ("DECODE_ERROR", b"[]"), 4: ("DECODE_ERROR", values[4][1])}


def test_a_limit_is_judged_by_the_time_taken(spark):
    from callmetrics.operators.delivery import timed_out

    schema = "call_id string, status string, error struct<code:string,message:string,retryable:boolean>, started_at timestamp, completed_at timestamp, per_file_timeout_seconds double"
    rows = [("in", "SUCCESS", None, NOW, NOW + timedelta(seconds=5), 5.0), ("over", "SUCCESS", None, NOW, NOW + timedelta(seconds=6), 5.0), ("open", "SUCCESS", None, NOW, None, 5.0), ("free", "FAILED", ("X", "m", False), NOW, NOW + timedelta(days=1), None)]
    got = {r["call_id"]: (r["status"], r["error"] and r["error"]["code"]) for r in timed_out(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"in": ("SUCCESS", None), "over": ("FAILED", "TIMEOUT"), "open": ("SUCCESS", None), "free": ("FAILED", "X")}


def test_a_decoder_of_ones_own_and_what_was_dropped(spark, tmp_path):
    """Other producers name their fields otherwise; what was published and dropped is counted by reason."""
    from callmetrics.sources.records import decoded

    from .test_delivery import flac

    rows = [(b'{"id":"c1","rec":"a1"}',), (b'{"id":"c2","rec":"gone"}',), (b'{"id":"c3","rec":"a2"}',), (b'{"call_id":"c4","audio_id":"a1"}',), (b"junk",)]
    spark.createDataFrame(rows, "raw binary").write.parquet(f"{tmp_path}/in")
    recordings = spark.createDataFrame([("a1", flac()), ("a2", flac(44100)), ("never", flac())], "audio_id string, content binary")
    stream = S.file_messages(spark, f"{tmp_path}/in", "raw binary")
    S.run_available(S.hydration(stream, recordings, f"{tmp_path}/out", f"{tmp_path}/cp", decode=lambda df: decoded(df, call="id", audio="rec")))
    assert [r["call_id"] for r in spark.read.parquet(f"{tmp_path}/out/references").collect()] == ["c1"]
    counts = {r["reason"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out/hydration_counts").collect()}
    assert counts == {"published": 1, "AUDIO_NOT_FOUND": 1, "AUDIO_NOT_CANONICAL": 1, "DECODE_ERROR": 2}

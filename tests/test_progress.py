"""Reports of streams, stop rules, late rows, registries."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callmetrics import streaming as S
from callmetrics.streaming import progress as P
from callmetrics.streaming import registry as R

NOW = datetime(2026, 1, 1)


def feed(spark, tmp_path, batches, schema="id long"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:04d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_reports_outlast_the_query(spark, tmp_path):
    """More than the hundred batches that Spark remembers."""
    (tmp_path / "in").mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(106):
        pq.write_table(pa.table({"id": pa.array([i], pa.int64())}), tmp_path / "in" / f"{i:04d}.parquet")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    listener = P.ProgressTable(spark, f"{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        query = stream.writeStream.format("noop").queryName("long_one").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(query.recentProgress) <= 100
        for _ in range(60):
            time.sleep(0.25)
            if not listener.held.get(str(query.runId), [1]):
                break
    finally:
        spark.streams.removeListener(listener)
    rows = P.lag_history(listener.table()).filter("input_rows > 0")
    assert rows.agg(F.countDistinct("batch"), F.sum("input_rows")).first()[:] == (106, 106) and {r["group_id"] for r in rows.collect()} == {"long_one"}


def test_lag_of_reports(spark):
    import json

    def report(done, there):
        return json.dumps({"timestamp": "2026-01-01T00:00:00.000Z", "numInputRows": 2, "sources": [{"endOffset": json.dumps({"t": {"0": done, "1": 1}}), "latestOffset": json.dumps({"t": {"0": there, "1": 1}})}, {"endOffset": None, "latestOffset": None}]})

    rows = spark.createDataFrame([("g", "r", 1, report(3, 10)), ("g", "r", 2, report(9, 10)), ("g", "r", 3, "{}")], "group_id string, run string, batch long, json string")
    assert [(r["batch"], r["lag"]) for r in P.lag_history(rows).orderBy("batch").collect()] == [(1, 7), (2, 1), (3, 0)]


@pytest.mark.parametrize("rule", ["accounted", "idle", "time"])
def test_stop_rules(spark, tmp_path, rule):
    stream = feed(spark, tmp_path, [[(i,)] for i in range(3)])
    writer = stream.writeStream.foreachBatch(lambda df, i: S.land(df, f"{tmp_path}/out", i)).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="200 milliseconds")
    looks = []

    def accounted():
        looks.append(1)
        return rule == "accounted" and len(looks) > 1 and spark.read.parquet(f"{tmp_path}/out").count() == 3

    limits = {"accounted": (60, 60), "idle": (3, 60), "time": (60, 4)}[rule]
    assert P.run_accounted(writer, accounted, idle_seconds=limits[0], most_seconds=limits[1], look_every=0.3) == rule
    assert looks and not spark.streams.active


def test_no_late_row_disappears(spark, tmp_path):
    at = lambda m: NOW + timedelta(minutes=m)
    batches = [[("a", at(0)), ("b", at(60))], [("late", at(10)), ("c", at(55)), ("none", None)], [("d", at(200))], [("late2", at(100)), ("e", at(195))]]
    stream = feed(spark, tmp_path, batches, "call_id string, at timestamp")
    S.run_available(P.parted_by_lateness(stream, "at", 600.0, f"{tmp_path}/out", f"{tmp_path}/cp"))
    calls = lambda name: sorted(r["call_id"] for r in spark.read.parquet(f"{tmp_path}/out/{name}").collect())
    assert calls("timely") == ["a", "b", "c", "d", "e"] and calls("late") == ["late", "late2", "none"]
    assert P.lateness(f"{tmp_path}/out", spark).agg(F.sum("timely"), F.sum("late")).first()[:] == (5, 3)
    # A stateful stream of the timely rows drops none.
    timely = spark.readStream.schema("call_id string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/out/timely")
    once = timely.withWatermark("at", "10 minutes").dropDuplicates(["call_id", "at"])
    S.run_available(once.writeStream.format("parquet").option("path", f"{tmp_path}/once").option("checkpointLocation", f"{tmp_path}/cp2"))
    assert sorted(r["call_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == ["a", "b", "c", "d", "e"]


REGISTRY = "function_id string, function_version string, upstream string"


def analyzer(name):
    """Appends the function's name to what its upstream has found."""

    def analyze(given):
        null = lambda kind: F.lit(None).cast(kind)
        before = F.col("payload") if "payload" in given.columns else F.lit("")
        return given.select(
            "call_id", F.lit(name).alias("function_id"), F.lit("1").alias("function_version"), F.when((F.col("call_id") == "stops") & (F.lit(name) == "b"), "SKIPPED").otherwise("SUCCESS").alias("status"), null("struct<code:string,message:string,retryable:boolean>").alias("error"),
            F.concat(before, F.lit(name)).alias("payload"), null("string").alias("payload_ref"), F.concat("call_id", F.lit(".flac")).alias("input_object_key"), F.lit(1).alias("attempt"), F.lit(3).alias("retry_budget"), F.lit(2.0).alias("retry_backoff_seconds"), F.lit(5.0).alias("retry_backoff_max_seconds"),
            null("binary").alias("key"), null("binary").alias("body"), null("string").alias("source_topic"), null("int").alias("source_partition"), null("long").alias("source_offset"), F.lit(NOW).alias("failed_at"), "depth",
        )

    return analyze


def test_a_chain_of_three_runs_from_its_declarations(spark, tmp_path):
    feed(spark, tmp_path, [[("x",), ("stops",)]], "call_id string")
    references = lambda: spark.readStream.schema("call_id string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    declared = spark.createDataFrame([("c", "1", "b"), ("a", "1", None), ("b", "1", "a"), ("alone", "1", None)], REGISTRY)
    streams = R.registry_streams(declared, {n: analyzer(n) for n in ("a", "b", "c", "alone")}, references, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert list(streams) == ["a", "alone", "b", "c"]
    for writer in streams.values():
        S.run_available(writer)
    got = {(r["call_id"], r["function_id"], r["payload"], r["depth"]) for r in spark.read.parquet(f"{tmp_path}/out/results").filter("status = 'SUCCESS'").collect()}
    assert got == {("x", "a", "a", 1), ("x", "b", "ab", 2), ("x", "c", "abc", 3), ("stops", "a", "a", 1), ("x", "alone", "alone", 1), ("stops", "alone", "alone", 1)}


def test_what_a_registry_refuses(spark):
    refused = {"cycle": [("a", "1", "b"), ("b", "1", "a")], "itself": [("a", "1", "a")], "unknown": [("a", "1", "nobody")], "deep": [(f"f{i}", "1", f"f{i - 1}" if i else None) for i in range(7)]}
    for rows in refused.values():
        with pytest.raises(ValueError):
            R.registry_streams(spark.createDataFrame(rows, REGISTRY), {r[0]: analyzer(r[0]) for r in rows}, lambda: None, "/nowhere", "/nowhere")
    with pytest.raises(ValueError, match="no analyzer"):
        R.registry_streams(spark.createDataFrame([("a", "1", None)], REGISTRY), {}, lambda: None, "/nowhere", "/nowhere")

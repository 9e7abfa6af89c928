"""Structured Streaming: ingest, analysis, retries, completeness and rates."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import backoff_seconds
from ..operators.accounting import rates
from ..operators.delivery import KEY, claim_checked, dead_letter_rows, failed_results, latest, poisoned, routed, timed_out, with_keys
from ..operators.fleet import terminal_events
from ..sources.events import read_references
from ..sources.records import canonical_gate, decoded, fetched, hydrated, streaminfo


def kafka_messages(spark: SparkSession, servers: str, topic: str, per_batch: int = 100_000) -> DataFrame:
    """Messages of a topic from its beginning, headers included; raw is the value."""
    kafka = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return kafka.option("includeHeaders", True).option("maxOffsetsPerTrigger", per_batch).load().withColumn("raw", F.col("value"))


def file_messages(spark: SparkSession, path: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """The same from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def land(df: DataFrame, path: str, batch_id: int, *partition: str) -> None:
    """Writes a micro-batch's rows below `batch=<id>`, in place of what is there: a batch that is run again changes nothing. Readers see `batch` as a column."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(f"{path}/batch={batch_id}")


def overwrite_latest(batch: DataFrame, batch_id: int, path: str, key: list[str], order: list[str]) -> None:
    """Adds a batch's last rows of each key to a keyed table; readers take the latest of all batches (`latest`)."""
    land(latest(batch, key, order), path, batch_id)


Decoder = Callable[[DataFrame], DataFrame]
#: Ids of a micro-batch that are broadcast at most; more are joined by a shuffle.
BATCH_IDS = 200_000


def hydration(messages: DataFrame, recordings: DataFrame, out: str, checkpoint: str, *, decode: Decoder = decoded) -> DataStreamWriter:
    """Ingest of call records: recordings are stored before the references that point to them, failures go to the hydrator's dead letters, and what was published or dropped, by reason, is counted.

    `decode` gives messages call_id, audio_id, ingested_at and error_code.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        asked = decode(batch).persist()
        # The batch's ids go to the recordings, which are many, before any content is read with them.
        ids = asked.filter("audio_id IS NOT NULL").select("audio_id").distinct()
        records = fetched(asked, recordings.join(F.broadcast(ids) if ids.count() <= BATCH_IDS else ids, "audio_id", "left_semi")).persist()
        bad = F.col("error_code").isNotNull()
        checked = records.filter(~bad).drop("error_code").withColumns(streaminfo())
        checked = canonical_gate(checked).persist()
        try:
            good = checked.filter("error_code IS NULL")
            land(good.select("call_id", F.concat("call_id", F.lit(".flac")).alias("object_key"), "content"), f"{out}/objects", batch_id)
            land(hydrated(good), f"{out}/references", batch_id)
            lost = records.filter(bad).select("raw", "call_id", "error_code").unionByName(checked.filter("error_code IS NOT NULL").select("raw", "call_id", "error_code"))
            land(lost, f"{out}/hydration_failures", batch_id)
            counted = good.select(F.lit("published").alias("reason")).unionByName(lost.select(F.col("error_code").alias("reason")))
            land(counted.groupBy("reason").agg(F.count("*").alias("n")), f"{out}/hydration_counts", batch_id)
        finally:
            for frame in (checked, records, asked):
                frame.unpersist()

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def analysis(outcomes: DataFrame, out: str, checkpoint: str, function: str, version: str) -> DataStreamWriter:
    """Outcomes of one function and version to results, large payloads, retries and dead letters; each has its own checkpoint, and so its own place in the stream.

    Outcomes have the columns of results and retry_budget, retry_backoff_seconds, retry_backoff_max_seconds, key, body,
    source_topic, source_partition, source_offset, failed_at.
    """
    at = f"{function}-{version}"

    def route(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _route(batch, batch_id, out, at)
        finally:
            batch.unpersist()

    return outcomes.writeStream.foreachBatch(route).option("checkpointLocation", f"{checkpoint}/{function}/{version}")


def _route(batch: DataFrame, batch_id: int, out: str, at: str, given: DataFrame | None = None, poison: DataFrame | None = None) -> None:
    """Writes outcomes where they belong; those with a limit of time are held to it. With `given`, the references of the batch (call_id, attempt, reference as JSON), retries carry theirs. `poison`: failures of messages that cannot be read."""
    if {"per_file_timeout_seconds", "started_at", "completed_at"} <= set(batch.columns):
        batch = timed_out(batch)
    done = claim_checked(batch.filter("status <> 'FAILED'"))
    land(done.filter("large_payload IS NOT NULL").select("payload_ref", "large_payload"), f"{out}/large_payloads/of={at}", batch_id)
    failures = routed(batch.filter("status = 'FAILED'").withColumn("retryable", F.col("error.retryable")))
    dead = failures.filter("route = 'DLQ'")
    columns = [*KEY, "status", "error", "input_object_key", "attempt"]
    lasting, letters = failed_results(dead).select(*columns), dead_letter_rows(dead)
    if poison is not None:
        lasting, letters = lasting.unionByName(failed_results(poison).select(*columns)), letters.unionByName(dead_letter_rows(poison))
    results = done.select(*columns, "payload", "payload_ref", *(["depth"] if "depth" in done.columns else [])).unionByName(lasting, allowMissingColumns=True).withColumn("envelope_version", F.lit(1))
    land(with_keys(results), f"{out}/results/of={at}", batch_id)
    land(letters, f"{out}/dead_letters/of={at}", batch_id, "function_id")
    waiting = retry_rows(failures.filter("route = 'RETRY'"))
    if given is not None:
        waiting = waiting.join(given.withColumn("attempt", F.col("attempt") + 1).dropDuplicates(["call_id", "attempt"]), ["call_id", "attempt"])
    land(waiting, f"{out}/retry_queue/of={at}", batch_id)


def message_analysis(messages: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, function: str, version: str) -> DataStreamWriter:
    """Analysis of messages as they come from a topic (the columns of `schemas.MESSAGES`): references to `analyze`, and what is none to dead letters and, where the key names a call, to a FAILED result.

    `analyze` takes the messages with the columns of their reference, and gives outcomes as `analysis` takes them.
    """
    at = f"{function}-{version}"

    def step(batch: DataFrame, batch_id: int) -> None:
        read = read_references(batch).persist()
        bad = F.col("error_code").isNotNull()
        poison = poisoned(read.filter(bad).select(*batch.columns), function, version, F.lit("the message holds no reference"))
        outcomes = analyze(read.filter(~bad).drop("error_code")).persist()
        try:
            _route(outcomes, batch_id, out, at, poison=poison)
        finally:
            outcomes.unpersist()
            read.unpersist()

    return messages.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{function}/{version}")


class _Retries(StatefulProcessor):
    """Per call the retries that are not due yet, each with a timer of its own; what has fired is remembered for a while, so that a batch that is run again wakes nobody twice."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "attempt int", "due_ms long, reference string")
        self.fired = handle.getMapState("fired", "attempt int", "at_ms long", ttlDurationMs=self.keep_ms)

    def _fire(self, key, now: int) -> Iterator[pd.DataFrame]:
        ready = sorted((a[0], v[1]) for a, v in self.waiting.iterator() if v[0] <= now)
        for attempt, _ in ready:
            self.waiting.removeKey((attempt,))
            self.fired.updateValue((attempt,), (now,))
        if ready:
            yield pd.DataFrame({"call_id": [key[0]] * len(ready), "attempt": [a for a, _ in ready], "reference": [r for _, r in ready]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for pdf in rows:
            for attempt, due_ms, reference in zip(pdf["attempt"], pdf["due_ms"], pdf["reference"], strict=True):
                at = (int(attempt),)
                if not self.waiting.containsKey(at) and not self.fired.containsKey(at):
                    self.waiting.updateValue(at, (int(due_ms), reference))
                    if due_ms > now:
                        self.handle.registerTimer(int(due_ms))
        yield from self._fire(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fire(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def due_retries(queue: DataFrame, keep_hours: int = 48) -> DataFrame:
    """Of a stream of retries (call_id, attempt, due_at, reference) each when its time has come: call_id, attempt, reference.

    Timers are those of processing time, so a retry fires whether or not there is new input, and the stream runs until it is
    stopped (with availableNow, too, as a later timer is always possible). State is what waits, and, for
    `keep_hours`, the numbers of attempts that have fired. Needs the RocksDB state store.
    """
    rows = queue.select("call_id", F.col("attempt").cast("int").alias("attempt"), F.unix_millis("due_at").alias("due_ms"), "reference").groupBy("call_id")
    return rows.transformWithStateInPandas(_Retries(keep_hours * 3_600_000), "call_id string, attempt int, reference string", "append", "ProcessingTime")


def retry_loop(references: DataFrame, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, function: str, version: str) -> tuple[DataStreamWriter, DataStreamWriter]:
    """Analysis with retries, as two streams to be started both: one analyzes references and retries that are due, one holds retries until they are.

    `analyze` takes references with `attempt` and gives outcomes as `analysis` takes them. A retry carries its reference
    through the queue, so no history is read again; a retry that has fired leaves the state.
    """
    spark, at = references.sparkSession, f"{function}-{version}"
    queue, ready = f"{out}/retry_queue/of={at}", f"{out}/retries_due/of={at}"
    schema, columns = references.schema, references.columns
    waiting = "call_id string, function_id string, function_version string, attempt int, delay_seconds double, due_at timestamp, reference string"
    woken = "call_id string, attempt int, reference string"
    for path, kind in ((queue, waiting), (ready, woken)):  # a stream of files needs its folder
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        outcomes = analyze(batch).persist()
        try:
            _route(outcomes, batch_id, out, at, batch.select("call_id", "attempt", F.to_json(F.struct(*columns)).alias("reference")))
        finally:
            outcomes.unpersist()
            batch.unpersist()

    again = spark.readStream.schema(woken).parquet(ready).select(F.from_json("reference", schema).alias("r"), "attempt").select("r.*", "attempt")
    both = references.withColumn("attempt", F.lit(1)).unionByName(again.select(*columns, "attempt"))
    held = due_retries(spark.readStream.schema(waiting).option("recursiveFileLookup", True).parquet(queue))
    return (
        both.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{function}/{version}"),
        held.writeStream.format("parquet").option("path", ready).option("checkpointLocation", f"{checkpoint}/{function}/{version}-retries").outputMode("append"),
    )


def live_tail(events: DataFrame, path: str, checkpoint: str, since: Column | None = None) -> DataStreamWriter:
    """Terminal events of a stream, newer than a cursor, to a table; `newest` shows the last of them."""
    found = terminal_events(events, since)
    return found.writeStream.foreachBatch(lambda batch, batch_id: land(batch, path, batch_id)).option("checkpointLocation", checkpoint)


def newest(tail: DataFrame, most: int = 300) -> DataFrame:
    """The newest events of a tail, newest first."""
    return tail.orderBy(F.desc("at"), "call_id").limit(most)


def progress_rows(query: StreamingQuery, group: str) -> list[tuple[str, str]]:
    """Progress reports of a running query as rows (group_id, json) for `fleet.progress_offsets`; Spark keeps a bounded number of them."""
    return [(group, p.json if hasattr(p, "json") else json.dumps(p)) for p in query.recentProgress]


def retry_rows(failures: DataFrame) -> DataFrame:
    """Failures that are to be run again: next attempt, and when it is due."""
    delay = backoff_seconds(F.col("attempt"), F.col("retry_backoff_seconds"), F.col("retry_backoff_max_seconds"))
    return failures.select(*KEY, (F.col("attempt") + 1).alias("attempt"), delay.alias("delay_seconds"), (F.col("failed_at").cast("double") + delay).cast("timestamp").alias("due_at"))


def due(queue: DataFrame, now) -> DataFrame:
    """Retries whose time has come."""
    return queue.filter(F.col("due_at") <= now)


def deduplicated(results: DataFrame, within: str = "48 hours") -> DataFrame:
    """The first result of each call, function and version within a time span, on a stream with `completed_at`."""
    return results.withWatermark("completed_at", within).dropDuplicatesWithinWatermark(KEY)


def windowed_rates(events: DataFrame, every: str = "5 minutes", slide: str | None = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rates of a stream of events, with late ones counted for a while."""
    return rates(events.withWatermark("at", late), every, slide)


class _Completeness(StatefulProcessor):
    """Per call the functions that have answered; one marker, when all have or when time is up. Then the answers go, and after a while the memory of the marker, too."""

    def __init__(self, expected: list[str], timeout_ms: int, keep_ms: int):
        self.expected, self.timeout_ms, self.keep_ms = set(expected), timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getMapState("answers", "function_id string", "status string")
        self.done = handle.getValueState("done", "until_ms long")

    def _closed(self, key, how: str, now: int) -> pd.DataFrame:
        seen = {k[0] for k in self.answers.keys()} & self.expected
        self.answers.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.done.update((now + self.keep_ms,))
        self.handle.registerTimer(now + self.keep_ms)
        return pd.DataFrame({"call_id": [key[0]], "marker": [how], "answered": [len(seen)], "missing": [",".join(sorted(self.expected - seen))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        first, unhydrated, earliest, latest_at = not any(True for _ in self.answers.keys()), False, None, 0
        for pdf in rows:
            for function, status, at in zip(pdf["function_id"], pdf["status"], pdf["at_ms"], strict=True):
                earliest, latest_at = int(at) if earliest is None else min(earliest, int(at)), max(latest_at, int(at))
                if status == "UNHYDRATED":
                    unhydrated = True
                else:
                    self.answers.updateValue((function,), (status,))
        watermark = timerValues.getCurrentWatermarkInMs()
        if unhydrated or self.expected <= {k[0] for k in self.answers.keys()}:
            yield self._closed(key, "unhydrated" if unhydrated else "complete", max(latest_at, watermark))
        elif first:  # the watermark is 0 in the first batch, so the call's own time counts
            self.handle.registerTimer(max(earliest or 0, watermark) + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            self.done.clear()
        else:
            yield self._closed(key, "timeout", max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def completeness(answers: DataFrame, expected: list[str], timeout_seconds: int = 3600, late: str = "10 minutes", keep_seconds: int = 48 * 3600) -> DataFrame:
    """One marker a call on a stream of answers (call_id, function_id, status, at): complete, timeout or unhydrated.

    `expected` are the active functions, configuration. A status of UNHYDRATED closes a call whose recording never came.
    Time is up `timeout_seconds` after the call's first answer by its own time, or after the watermark if that is later. A closed call is remembered for
    `keep_seconds` of event time, in which late answers change nothing; then nothing of it is left in the state. Rows without a time are not seen.
    Needs the RocksDB state store.
    """
    stream = answers.filter("at IS NOT NULL").select("call_id", "function_id", "status", "at", F.unix_millis("at").alias("at_ms")).withWatermark("at", late).groupBy("call_id")
    processor = _Completeness(expected, timeout_seconds * 1000, keep_seconds * 1000)
    return stream.transformWithStateInPandas(processor, "call_id string, marker string, answered long, missing string", "append", "EventTime")


def run_available(writer: DataStreamWriter) -> None:
    """Runs a stream over all that is there, and ends."""
    writer.trigger(availableNow=True).start().awaitTermination()


def backfill(spark: SparkSession, path: str, schema: str, analyze: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """A new version of a function over history, at its own pace and with its own checkpoint."""
    stream = file_messages(spark, path, schema, files_per_batch)
    run_available(stream.writeStream.foreachBatch(lambda batch, batch_id: land(analyze(batch), out, batch_id)).option("checkpointLocation", checkpoint))


def chain_depth(edges: DataFrame, most: int = 5) -> DataFrame:
    """Depth of each function in the graph of who consumes whose results (upstream, downstream); more than `most` levels, or a cycle, is an error.

    Levels come from joins over the declared edges, which are configuration. A function on a cycle, or behind one, has no
    depth and is not allowed.
    """
    names = edges.select(F.col("upstream").alias("function_id")).union(edges.select("downstream")).distinct()
    level = edges.select(F.col("upstream").alias("function_id")).subtract(edges.select("downstream")).withColumn("depth", F.lit(1))
    found = level
    for depth in range(2, most + 2):
        level = level.join(edges, level["function_id"] == edges["upstream"]).select(F.col("downstream").alias("function_id"), F.lit(depth).alias("depth")).distinct()
        found = found.unionByName(level)
    out = names.join(found.groupBy("function_id").agg(F.max("depth").alias("depth")), "function_id", "left")
    looped = names.join(out.filter("depth IS NULL"), "function_id", "left_semi").withColumn("loop", F.lit(True))
    for _ in range(most):
        looped = looped.union(looped.join(edges, looped["function_id"] == edges["upstream"]).select(F.col("downstream"), F.lit(True))).distinct()
    out = out.join(looped, "function_id", "left").withColumn("depth", F.when(F.col("loop").isNull(), F.col("depth")))
    return out.select("function_id", "depth", F.coalesce(F.col("depth") <= most, F.lit(False)).alias("allowed"))

"""What running streams report, kept as a table; streams that stop when their work is accounted for; rows that come late."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from . import land


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A new small file, whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = hadoop(f"{path}.draft"), hadoop(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(draft, final)


class ProgressTable(StreamingQueryListener):
    """Appends the reports of all streams of a session to a folder: group_id (the query's name), run, batch, json.

    Spark keeps the last hundred reports of a query in memory; here all are kept, `every` to a file, and what is left
    when a query ends. `fleet.progress_offsets` reads the table as it is.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.held: dict[str, list[tuple[str, str, int, str]]] = {}

    def onQueryStarted(self, event) -> None:
        self.held[str(event.runId)] = []

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = self.held.setdefault(str(p.runId), [])
        rows.append((p.name or str(p.id), str(p.runId), p.batchId, p.json))
        if len(rows) >= self.every:
            self.flush(str(p.runId))

    def onQueryIdle(self, event) -> None:
        self.flush(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self.flush(str(event.runId))

    def flush(self, run: str) -> None:
        """Writes what is held of a run."""
        import json

        rows, self.held[run] = self.held.get(run, []), []
        if rows:
            lines = (json.dumps({"group_id": g, "run": r, "batch": b, "json": j}) for g, r, b, j in rows)
            _write(self.spark, f"{self.path}/{run}-{rows[-1][2]:012d}-{uuid.uuid4().hex[:8]}.json", "\n".join(lines) + "\n")

    def table(self) -> DataFrame:
        """All reports that were written."""
        return self.spark.read.schema("group_id string, run string, batch long, json string").json(f"{self.path}/*.json")


def lag_history(progress: DataFrame) -> DataFrame:
    """Rows taken and rows left behind, of each batch of each query: group_id, batch, at, input_rows, lag. The lag is the sum, over sources of topics, of the latest less the end offsets."""
    at = "MAP<STRING, MAP<STRING, BIGINT>>"
    report = F.from_json("json", "timestamp STRING, numInputRows BIGINT, sources ARRAY<STRUCT<endOffset: STRING, latestOffset: STRING>>")
    total = lambda c: F.aggregate(F.flatten(F.transform(F.map_values(F.from_json(c, at)), lambda m: F.map_values(m))), F.lit(0).cast("long"), lambda a, x: a + x)
    lag = F.aggregate(F.coalesce("r.sources", F.array()), F.lit(0).cast("long"), lambda a, s: a + F.greatest(F.lit(0).cast("long"), F.coalesce(total(s["latestOffset"]) - total(s["endOffset"]), F.lit(0).cast("long"))))
    rows = progress.withColumn("r", report)
    return rows.select("group_id", "batch", F.try_to_timestamp("r.timestamp").alias("at"), F.col("r.numInputRows").alias("input_rows"), lag.alias("lag"))


def run_accounted(writer: DataStreamWriter, accounted: Callable[[], bool], *, idle_seconds: float, most_seconds: float, look_every: float = 1.0) -> str:
    """Runs a stream until all is accounted for, nothing came for a while, or time is up; which of `accounted`, `idle`, `time` it was.

    `accounted` is asked after a batch with rows, and once at the start and at the end. A stream that fails raises its error.
    """
    query = writer.start()
    began = last = time.monotonic()
    seen, why = -1, ""
    try:
        if accounted():
            why = "accounted"
        while not why:
            time.sleep(look_every)
            if not query.isActive:
                query.awaitTermination()
                return "accounted" if accounted() else "idle"
            batch = max((p.batchId for p in query.recentProgress if p.numInputRows), default=-1)
            now = time.monotonic()
            if batch > seen:
                seen, last = batch, now
                if accounted():
                    why = "accounted"
            elif now - last >= idle_seconds and not query.status["isTriggerActive"]:
                why = "idle"
            if not why and now - began >= most_seconds:
                why = "time"
    finally:
        query.stop()
    return why


def parted_by_lateness(stream: DataFrame, at: str, late_seconds: float, out: str, checkpoint: str) -> DataStreamWriter:
    """Rows beyond the watermark to `<out>/late`, all others to `<out>/timely`: none disappears.

    The watermark is that of the batches before: their latest time less `late_seconds`, kept beside the rows. A stateful stream reads the
    timely rows with the same watermark and drops none of them, as long as it takes their batches in order; late ones are looked up anew (`with_fallback`).
    Rows without a time are late.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            seen = spark.read.schema("batch long, latest double").json(f"{out}/watermarks").filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        except AnalysisException:  # the first batch
            seen = None
        try:
            time_ = F.col(at).cast("double")
            good = F.coalesce(time_ >= (float("-inf") if seen is None else seen - late_seconds), F.lit(False))
            land(batch.filter(good), f"{out}/timely", batch_id)
            land(batch.filter(~good), f"{out}/late", batch_id)
            latest = batch.agg(F.max(time_)).first()[0]
            if latest is not None:
                spark.createDataFrame([(batch_id, latest)], "batch long, latest double").coalesce(1).write.mode("overwrite").json(f"{out}/watermarks/of={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def lateness(out: str, spark: SparkSession) -> DataFrame:
    """Rows of each batch that came in time and late: for the report."""
    count = lambda name: spark.read.parquet(f"{out}/{name}").groupBy("batch").agg(F.count("*").alias(name))
    both = count("timely").join(count("late"), "batch", "full_outer")
    return both.select("batch", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("timely", "late")])

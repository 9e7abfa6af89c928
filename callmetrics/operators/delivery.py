"""Results, retries, dead letters and what is still missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import object_key, result_key, seconds_between, truncated_bytes
from ..schemas import CLAIM_CHECK_BYTES, HYDRATOR, STATUSES

KEY = ["call_id", "function_id", "function_version"]


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`. Aggregates before it shuffles, so a key with many rows is no burden."""
    rest = [c for c in df.columns if c not in key]
    whole = F.struct(*[F.col(c) for c in rest])
    return df.groupBy(*key).agg(F.max_by(whole, F.struct(*order)).alias("_last")).select(*key, *[F.col("_last")[c].alias(c) for c in rest])


def marked_duplicates(results: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `duplicate`: true for all but the first result of a call within a function."""
    w = Window.partitionBy("function_id", "call_id").orderBy(*order)
    return results.withColumn("duplicate", F.row_number().over(w) > 1)


def valid_result() -> Column:
    """A status that is known, and not both an inline payload and a reference to one."""
    return F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)) & ~(F.col("payload").isNotNull() & F.col("payload_ref").isNotNull())


def routed(failures: DataFrame) -> DataFrame:
    """Failures with `route` (RETRY or DLQ): retried while retryable and below the budget. Needs retryable, attempt, retry_budget."""
    return failures.withColumn("route", F.when(F.coalesce("retryable", F.lit(False)) & (F.col("attempt") < F.col("retry_budget")), "RETRY").otherwise("DLQ"))


def timed_out(outcomes: DataFrame) -> DataFrame:
    """Outcomes that took longer than per_file_timeout_seconds become FAILED with a retryable TIMEOUT. It is judged when the outcome is there."""
    late = seconds_between("started_at", "completed_at") > F.col("per_file_timeout_seconds")
    error = F.struct(F.lit("TIMEOUT").alias("code"), F.lit("took longer than its limit").alias("message"), F.lit(True).alias("retryable"))
    return outcomes.withColumns({"status": F.when(late, "FAILED").otherwise(F.col("status")), "error": F.when(late, error).otherwise(F.col("error"))})


def claim_checked(results: DataFrame, limit: int = CLAIM_CHECK_BYTES) -> DataFrame:
    """Payloads of SUCCESS below the limit stay inline; larger ones get a `payload_ref`; others have neither.

    `large_payload` keeps what belongs into the side table under `payload_ref`.
    """
    keep = (F.col("status") == "SUCCESS") & (F.octet_length("payload") > 0)
    big = keep & (F.octet_length("payload") >= limit)
    ref = F.concat_ws("/", F.lit("results"), "function_id", "function_version", "call_id")
    return results.withColumns({"payload_ref": F.when(big, ref), "large_payload": F.when(big, F.col("payload")), "payload": F.when(keep & ~big, F.col("payload"))})


def resolved(results: DataFrame, large: DataFrame) -> DataFrame:
    """Payloads wherever they are: `large` has payload_ref and large_payload."""
    return results.drop("large_payload").join(large.select("payload_ref", "large_payload"), "payload_ref", "left").withColumn("payload", F.coalesce("payload", "large_payload")).drop("large_payload")


def with_keys(results: DataFrame) -> DataFrame:
    return results.withColumns({"result_key": result_key(), "partition_key": F.col("call_id")})


def dead_letter_rows(failures: DataFrame) -> DataFrame:
    """Dead letters of failed inputs: original key and body untouched, the message cut to 1024 bytes."""
    return failures.select(
        "function_id", "function_version", F.concat_ws(":", "function_id", "function_version").alias("group_id"), F.col("error.code").alias("error_code"), truncated_bytes(F.col("error.message")).alias("error_message"),
        F.col("error.retryable").alias("retryable"), "attempt", "call_id", "source_topic", "source_partition", "source_offset", F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("failed_at"), "key", "body",
    )


def poisoned(messages: DataFrame, function: str, version: str, message: Column) -> DataFrame:
    """Failures of messages that cannot be read: the call is what the key says, the attempt the first, and nothing is retried. A message without a readable key has no call, so it gets a dead letter and no FAILED result."""
    call = F.when(F.is_valid_utf8(F.col("key").cast("string")), F.col("key").cast("string")).otherwise("")
    error = F.struct(F.lit("DECODE_ERROR").alias("code"), message.alias("message"), F.lit(False).alias("retryable"))
    return messages.select(
        F.lit(function).alias("function_id"), F.lit(version).alias("function_version"), F.coalesce(call, F.lit("")).alias("call_id"), error.alias("error"), F.lit(1).alias("attempt"),
        F.col("topic").alias("source_topic"), F.col("partition").alias("source_partition"), F.col("offset").alias("source_offset"), F.col("timestamp").alias("failed_at"), "key", F.col("value").alias("body"),
    )


def failed_results(failures: DataFrame) -> DataFrame:
    """The FAILED results that go with dead letters of readable calls; the hydrator has none."""
    kept = failures.filter(F.col("call_id").isNotNull() & (F.col("call_id") != "") & (F.col("function_id") != HYDRATOR))
    return kept.select("call_id", "function_id", "function_version", F.lit("FAILED").alias("status"), "error", object_key().alias("input_object_key"), "attempt")


def replays(dead_letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Original messages to put back on their source: requests name function_id, source_partition and source_offset. Letters without a source are refused (`refused`)."""
    found = dead_letters.join(requests.distinct(), ["function_id", "source_partition", "source_offset"], "left_semi")
    return found.select("function_id", F.col("source_topic").alias("topic"), "key", F.col("body").alias("value"), "call_id", "source_partition", "source_offset", F.col("source_topic").isNull().alias("refused"))


def answered(results: DataFrame, dead_letters: DataFrame) -> DataFrame:
    """(call, function) pairs that have a result of any status or a dead letter."""
    return results.select("call_id", "function_id").union(dead_letters.select("call_id", "function_id")).filter("call_id IS NOT NULL").distinct()


def expected_functions(declarations: DataFrame) -> Column:
    """The declared functions but the hydrator, in order, as one array: a scalar subquery."""
    return declarations.filter(F.col("function_id") != HYDRATOR).agg(F.sort_array(F.collect_set("function_id"))).scalar()


def missing(hydrated: DataFrame, declarations: DataFrame, answered_pairs: DataFrame) -> DataFrame:
    """(call, function) pairs that are expected and not answered.

    The expected functions of a call are an array on its own row, so the calls are not multiplied before the answers
    are taken away: declarations are configuration, a few rows.
    """
    got = answered_pairs.groupBy("call_id").agg(F.collect_set("function_id").alias("got"))
    df = hydrated.select("call_id").distinct().join(got, "call_id", "left").withColumn("expected", expected_functions(declarations))
    return df.select("call_id", F.explode(F.array_except("expected", F.coalesce("got", F.array().cast("array<string>")))).alias("function_id"))


def call_trace(references: DataFrame, results: DataFrame, dead_letters: DataFrame, declarations: DataFrame, order: list[str]) -> DataFrame:
    """One row a call: its results (latest by function and version, by function_id), dead letters, missing functions and completeness.

    A call without a reference but with results or dead letters is not hydrated and misses nothing.
    """
    last = latest(results, KEY, order)
    r = last.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("function_id", "function_version", "status", "attempt"))).alias("results"))
    d = dead_letters.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("function_id", "error_code", "attempt"))).alias("dead_letters"))
    refs = references.select("call_id", F.lit(True).alias("_hydrated")).distinct()
    df = refs.join(r, "call_id", "full_outer").join(d, "call_id", "full_outer").withColumn("expected", expected_functions(declarations))
    none = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.transform(c, lambda x: x["function_id"]), none)
    hydrated = F.coalesce("_hydrated", F.lit(False))
    gone = F.when(hydrated, F.array_except("expected", F.array_union(names(F.col("results")), names(F.col("dead_letters"))))).otherwise(none)
    return df.select("call_id", hydrated.alias("hydrated"), "results", "dead_letters", gone.alias("missing"), (hydrated & (F.size(gone) == 0)).alias("complete"))


def duration_disagreement(results: DataFrame, references: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Measured less claimed seconds of the duration_rms result; null if either is missing or the claim is 0."""
    measured = results.filter((F.col("function_id") == "duration_rms") & F.col("payload").isNotNull()).groupBy("call_id").agg(F.min_by(F.get_json_object("payload", "$.duration_seconds").try_cast("double"), "function_version").alias("measured"))
    gap = F.col("measured") - F.nullif(F.col("duration_seconds"), F.lit(0.0))
    return references.join(measured, "call_id", "left").select("call_id", gap.alias("disagreement"), F.coalesce(F.abs(gap) > tolerance, F.lit(False)).alias("flagged"))


def version_diff(results: DataFrame, function: str, old: str, new: str, measure: Column, tolerance: float = 0.0) -> DataFrame:
    """Calls of one function under two versions: `change` is same, changed, only_old or only_new."""
    side = lambda v, name: results.filter((F.col("function_id") == function) & (F.col("function_version") == v)).select("call_id", measure.alias(name), F.lit(True).alias("has_" + name))
    df = side(old, "old").join(side(new, "new"), "call_id", "full_outer")
    same = F.when(F.col("old").isNull() | F.col("new").isNull(), F.col("old").isNull() & F.col("new").isNull()).otherwise(F.abs(F.col("old") - F.col("new")) <= tolerance)
    return df.select("call_id", "old", "new", F.when(F.col("has_new").isNull(), "only_old").when(F.col("has_old").isNull(), "only_new").when(same, "same").otherwise("changed").alias("change"))


def erased(df: DataFrame, erasures: DataFrame) -> DataFrame:
    """The rows of calls that no erasure names."""
    return df.join(erasures.select("call_id").distinct(), "call_id", "left_anti")


def compacted(df: DataFrame, erasures: DataFrame, path: str, partition: str) -> DataFrame:
    """Rewrites a table partitioned by a column without the erased calls, into `path`: only partitions that hold one are written anew there, and the rows of these partitions are returned."""
    gone = erasures.select("call_id").distinct()
    touched = df.join(gone, "call_id", "left_semi").select(partition).distinct()
    df.join(touched, partition, "left_semi").join(gone, "call_id", "left_anti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tombstones(erasures: DataFrame, history: DataFrame) -> DataFrame:
    """A tombstone for every (function, version) that ever answered an erased call."""
    return history.select(*KEY).distinct().join(erasures.select("call_id").distinct(), "call_id", "left_semi").withColumn("result_key", result_key())

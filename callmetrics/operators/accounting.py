"""Counts, lags, rates and alerts over results, dead letters, events and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds_between
from ..schemas import HYDRATOR


def function_tally(results: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Of each function: results, unique calls, duplicates, statuses, attempts, audio seconds, first and last seen, calls a second."""
    if expected is not None:  # call_id, seconds
        results = results.join(expected.select("call_id", "seconds"), "call_id", "left")
    seconds = F.coalesce("seconds", F.lit(0.0)) if expected is not None else F.lit(0.0)
    calls = results.withColumn("_s", seconds).groupBy("function_id", "call_id").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "FAILED", "SKIPPED")], F.max("attempt").alias("attempt"), F.sum("_s").alias("audio"), F.min("completed_at").alias("first"), F.max("completed_at").alias("last")
    )
    out = calls.groupBy("function_id").agg(
        F.sum("n").alias("results"), F.count("*").alias("unique_calls"), (F.sum("n") - F.count("*")).alias("duplicates"), *[F.sum(s).alias(s) for s in ("success", "failed", "skipped")],
        F.max("attempt").alias("max_attempt"), F.sum("audio").alias("audio_seconds"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )
    wall = F.nullif(seconds_between("first_seen", "last_seen"), F.lit(0.0))
    return out.withColumn("calls_per_second", F.col("unique_calls") / wall)


def realtime_multiple(results: DataFrame, audio: DataFrame, floor: float = 25.0) -> DataFrame:
    """Audio seconds for each processing second, by function; null where either sum is not positive."""
    df = results.join(audio.select("call_id", "duration_seconds"), "call_id").groupBy("function_id").agg(F.sum("duration_seconds").alias("a"), F.sum(seconds_between("started_at", "completed_at")).alias("p"))
    ratio = F.when((F.col("a") > 0) & (F.col("p") > 0), F.col("a") / F.col("p"))
    return df.select("function_id", ratio.alias("multiple"), F.coalesce(ratio >= floor, F.lit(False)).alias("meets_floor"))


def dead_letters_by_code(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("function_id", F.coalesce("error_code", F.lit("?")).alias("error_code")).agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("calls"))


def outcome_counters(events: DataFrame) -> DataFrame:
    """Events by function and name."""
    return events.groupBy("function_id", "event_name").agg(F.count("*").alias("n"))


def group_lag(offsets: DataFrame) -> DataFrame:
    """Lag of each group over its partitions; committed below 0 means never, and then the lag is all there is."""
    behind = F.greatest(F.lit(0), F.when(F.col("committed") < 0, F.col("high") - F.col("low")).otherwise(F.col("high") - F.col("committed")))
    return offsets.groupBy("group_id").agg(F.sum(behind).alias("lag"), F.count_if(F.col("committed") < 0).alias("uncommitted"))


def hydrated_calls(events: DataFrame) -> DataFrame:
    """Calls that were hydrated: the hydrator completed them, or any function received them."""
    proof = ((F.col("function_id") == HYDRATOR) & (F.col("event_name") == "call.completed")) | ((F.col("function_id") != HYDRATOR) & (F.col("event_name") == "call.received"))
    return events.groupBy("call_id").agg(F.max(F.coalesce(proof, F.lit(False))).alias("hydrated"))


def registry(declarations: DataFrame, groups: DataFrame) -> DataFrame:
    """Declared functions with their groups' lag, null where none runs."""
    return declarations.join(groups.withColumn("function_id", F.split("group_id", ":", 2)[0]), "function_id", "left")


def drift(declarations: DataFrame, running: DataFrame) -> DataFrame:
    """Functions that run undeclared or are declared and do not run."""
    d, r = declarations.select("function_id").distinct().withColumn("d", F.lit(True)), running.select("function_id").distinct().withColumn("r", F.lit(True))
    return d.join(r, "function_id", "full_outer").select("function_id", F.when(F.col("d").isNull(), "undeclared").when(F.col("r").isNull(), "not_running").alias("drift")).filter("drift IS NOT NULL")


def lint(declarations: DataFrame, topics: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Findings on declarations against the topics that exist (name, partitions): severity, subject, message. Topics in `required` must exist whoever declares them."""
    t = lambda c: topics.select(F.col("name").alias(c), F.col("partitions").alias(c + "_partitions_there"))
    df = declarations.join(t("input_topic"), "input_topic", "left").join(t("results_topic"), "results_topic", "left").join(t("dlq_topic"), "dlq_topic", "left")
    there, declared = F.col("results_topic_partitions_there"), F.col("results_topic_partitions")
    found = lambda when, severity, message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message")))
    each = F.array(
        found(F.col("input_topic_partitions_there").isNull(), "error", "input topic is missing"), found(there.isNull(), "error", "results topic is missing"),
        found(declared > there, "error", "declares more partitions than there are"), found(declared < there, "warning", "declares fewer partitions than there are"),
        found(F.col("dlq_topic_partitions_there").isNull(), "warning", "dead-letter topic is missing"),
    )
    out = df.select(F.col("function_id").alias("subject"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.severity", "subject", "f.message")
    if not required:
        return out
    names = declarations.sparkSession.createDataFrame([(n,) for n in required], "name string")
    gone = names.join(topics.select("name"), "name", "left_anti")
    return out.unionByName(gone.select(F.lit("error").alias("severity"), F.col("name").alias("subject"), F.lit("required topic is missing").alias("message")))


def topic_plan(declarations: DataFrame, raw: str = "calls.raw", raw_partitions: int = 12, dlq_partitions: int = 3) -> DataFrame:
    """Topics that the declarations imply: name, partitions."""
    own = declarations.select(F.explode(F.array(F.struct(F.col("input_topic").alias("name"), F.col("results_topic_partitions").alias("partitions")), F.struct(F.col("results_topic").alias("name"), F.col("results_topic_partitions").alias("partitions")), F.struct(F.col("dlq_topic").alias("name"), F.lit(dlq_partitions).alias("partitions")))).alias("t")).select("t.name", "t.partitions")
    fixed = declarations.sparkSession.createDataFrame([(raw, raw_partitions)], "name string, partitions int")
    return own.filter(F.col("name") != raw).groupBy("name").agg(F.max("partitions").alias("partitions")).union(fixed)


def unaccounted(expected: DataFrame, hydrator_failures: DataFrame, answered_pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Reachable calls that a function has not answered: function_id, n_missing, first five of them."""
    reachable = expected.select("call_id").distinct().join(hydrator_failures.select("call_id").distinct(), "call_id", "left_anti")
    names = functions.agg(F.sort_array(F.collect_set("function_id"))).scalar()
    got = answered_pairs.groupBy("call_id").agg(F.collect_set("function_id").alias("got"))
    gone = reachable.join(got, "call_id", "left").withColumn("names", names).select("call_id", F.explode(F.array_except("names", F.coalesce("got", F.array().cast("array<string>")))).alias("function_id"))
    first = Window.partitionBy("function_id", "_salt").orderBy("call_id")
    few = gone.withColumn("_salt", F.pmod(F.xxhash64("call_id"), F.lit(64))).withColumn("_i", F.row_number().over(first)).filter("_i <= 5").groupBy("function_id").agg(F.slice(F.array_sort(F.collect_list("call_id")), 1, 5).alias("examples"))
    return gone.groupBy("function_id").agg(F.count("*").alias("n_missing")).join(few, "function_id")


def report(expected: DataFrame, results: DataFrame, dead_letters: DataFrame, functions: DataFrame, undecodable: int = 0) -> DataFrame:
    """One row a function: results, unique calls, duplicates, dead-letter calls, missing, and whether all is accounted for."""
    tally = function_tally(results).select("function_id", "results", "unique_calls", "duplicates")
    dlq = dead_letters.groupBy("function_id").agg(F.countDistinct("call_id").alias("dlq_calls"))
    pairs = results.select("call_id", "function_id").union(dead_letters.select("call_id", "function_id")).distinct()
    failed = dead_letters.filter(F.col("function_id") == HYDRATOR)
    gone = unaccounted(expected, failed, pairs, functions)
    df = functions.select("function_id").distinct().join(tally, "function_id", "left").join(dlq, "function_id", "left").join(gone, "function_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = df.select("function_id", *[n(c).alias(c) for c in ("results", "unique_calls", "duplicates", "dlq_calls", "n_missing")], F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    return out.withColumn("passed", (F.col("n_missing") == 0) & (F.col("duplicates") == 0) & F.lit(undecodable == 0))


def in_flight(events: DataFrame) -> DataFrame:
    """Calls under way after each event, by function: +1 when received, -1 when completed or dead-lettered.

    Events are added up by second first; a function's row count is then at most its seconds.
    """
    step = F.when(F.col("event_name") == "received", 1).when(F.col("event_name").isin("completed", "dead_lettered"), -1).otherwise(0)
    by = events.withColumn("second", F.date_trunc("second", "at")).groupBy("function_id", "second").agg(F.sum(step).alias("change"))
    return by.withColumn("depth", F.sum("change").over(Window.partitionBy("function_id").orderBy("second")))


def rates(events: DataFrame, every: str, slide: str | None = None) -> DataFrame:
    """Events a second in tumbling or sliding windows, by function and name; streams need a watermark first."""
    window = F.window("at", every, slide) if slide else F.window("at", every)
    seconds = seconds_between("window.start", "window.end")
    out = events.groupBy(window.alias("window"), "function_id", "event_name").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "function_id", "event_name", "n", (F.col("n") / seconds).alias("per_second"))


def lag_seconds(lag: Column, rate: Column) -> Column:
    """Backlog in time: infinite if nothing moves, not a number if there is nothing to move."""
    return F.when(rate > 0, lag / rate).when(lag > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def alerts(samples: DataFrame, warn: float = 3600.0, page: float = 10800.0, sustained: int = 10) -> DataFrame:
    """Samples (group_id, at, lag, rate) with `warn` and `page`: the backlog exceeded a limit in each of the last `sustained` samples; `stalled`: lag without progress for 5."""
    behind = lag_seconds(F.col("lag"), F.col("rate"))
    w = lambda k: Window.partitionBy("group_id").orderBy("at").rowsBetween(1 - k, 0)
    all_of = lambda c, k: (F.min(c.cast("int")).over(w(k)) == 1) & (F.count("*").over(w(k)) == k)
    over = lambda x: ~F.isnan(behind) & (behind > x)
    stalled = (F.col("lag") > 0) & (F.col("rate") == 0)
    return samples.select("group_id", "at", behind.alias("lag_seconds"), all_of(over(warn), sustained).alias("warn"), all_of(over(page), sustained).alias("page"), all_of(stalled, 5).alias("stalled"))


def retry_ladder(events: DataFrame, order: list[str]) -> DataFrame:
    """The ordered event names of each call and function, and whether the last one is terminal."""
    df = events.groupBy("call_id", "function_id").agg(F.array_sort(F.collect_list(F.struct(*order, "event_name"))).alias("e"))
    names = F.transform("e", lambda x: x["event_name"])
    return df.select("call_id", "function_id", names.alias("ladder"), F.element_at(names, -1).isin("completed", "dead_lettered").alias("terminal"))


def graded(payloads: DataFrame) -> DataFrame:
    """Grades of parsed payloads: function_id and a map of numbers `m` give `grade` (good, warn, bad or null), a `fraction`, `claim_grade` (bad where a measured duration is more than a second off the claimed one) and a `note`."""
    m = lambda k: F.element_at("m", F.lit(k))
    f = F.col("function_id")
    grade = (
        F.when(f == "duration_rms", F.when(m("dbfs") > -3, "bad").when(m("dbfs") < -50, "warn").otherwise("good"))
        .when(f == "silence_ratio", F.when(m("silence_ratio") > 0.6, "warn").otherwise("good"))
        .when(f == "clipping_detect", F.when(m("clipped") > 0, "bad").otherwise("good"))
        .when(f == "energy_vad", F.when(m("speech_ratio") > 0.1, "good").otherwise("warn"))
        .when(f == "spectral_rolloff", F.when(m("band_limited") > 0, "warn").otherwise("good"))
        .when(f == "snr_estimate", F.when(m("confidence") < 0.4, "warn").when(m("snr_db") > 20, "good"))
    )
    fraction = F.when(f == "duration_rms", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m("dbfs") + 60) / 60))).when(f == "spectral_centroid", F.least(F.lit(1.0), m("centroid_hz") / m("nyquist_hz"))).when(f == "zero_crossing_rate", F.least(F.lit(1.0), m("zcr_per_second") / 4000))
    gap = F.abs(m("duration_seconds") - F.nullif(m("reference_duration_seconds"), F.lit(0.0)))
    claim = F.when((f == "duration_rms") & gap.isNotNull(), F.when(gap > 1, "bad").otherwise("good"))
    note = F.when((f == "energy_vad") & (m("first_speech_seconds") < 0), "never")
    return payloads.withColumns({"grade": grade, "fraction": fraction, "claim_grade": claim, "note": note})

"""Queries over groups, topics, frequencies, traces, reports, quantiles and alerts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounting as C
from ..operators import fleet as T
from ..operators.signals import frames, power
from ..sources import events as E
from ..sources import records as R
from . import adapters as D
from .analysis import Query, rounded
from .operations import suppliers

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql
        return f

    return keep


_LAGS = D.OFFSETS + """, lags AS (
  SELECT group_id, CAST(sum(greatest(0, CASE WHEN committed < 0 THEN high - low ELSE high - committed END)) AS BIGINT) AS lag, CAST(sum(CASE WHEN committed < 0 THEN 1 ELSE 0 END) AS BIGINT) AS uncommitted FROM off GROUP BY group_id
)"""


@query("fleet_order", "WITH" + _LAGS + """
SELECT group_id, lag, uncommitted, split_part(group_id, ':', 1) AS function_id, split_part(group_id, ':', 2) AS function_version, row_number() OVER (ORDER BY lag DESC, group_id) AS place FROM lags WHERE NOT starts_with(group_id, 'fn_1')
""")
def fleet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose names begin with fn_1 stand for those of the tools. A row a group: the place is the row's number in that order."""
    from pyspark.sql import Window

    return T.fleet(D.offsets(spark, sf_dir), ("fn_1",)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("lag"), "group_id")).cast("long"))


@query("worst_lag", "WITH" + _LAGS + " SELECT group_id, lag FROM lags ORDER BY lag DESC, group_id LIMIT 1")
def worst_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.worst_lag(C.group_lag(D.offsets(spark, sf_dir)).select("group_id", "lag"))


_TOPICS = """
WITH t AS (
  SELECT 'calls.results.' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'calls.dlq.' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT DISTINCT 'calls.internal' FROM supplier UNION ALL SELECT n_name FROM nation
)"""


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir)[1].select("name").unionByName(D.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("topics_by_name", _TOPICS + " SELECT name FROM t WHERE starts_with(name, 'calls.') ORDER BY name")
def topics_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.topics_by_name(_topics(spark, sf_dir))


@query("dead_letter_topics", _TOPICS + " SELECT name FROM t WHERE starts_with(name, 'calls.') AND contains(name, '.dlq.')")
def dead_letter_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dead_letter_topics(_topics(spark, sf_dir))


_HOURS = D.EVENT_LOG + """, hours AS (
  SELECT function_id AS group_id, date_trunc('hour', "at") AS "at", CAST(sum(CASE WHEN event_name = 'received' THEN 600 ELSE 0 END) AS BIGINT) AS lag, CAST(sum(CASE WHEN event_name = 'completed' THEN 1 ELSE 0 END) AS BIGINT) / 3600.0 AS rate,
         CAST(sum(CASE WHEN event_name = 'dead_lettered' THEN 1 ELSE 0 END) AS BIGINT) / 3600.0 AS letters, quantile_cont(process_seconds, 0.5) AS median
  FROM log GROUP BY ALL
)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, named = D.event_log(spark, sf_dir), lambda name: F.count_if(F.col("event_name") == name)
    return log.groupBy(F.col("function_id").alias("group_id"), F.date_trunc("hour", "at").alias("at")).agg((600 * named("received")).alias("lag"), (named("completed") / 3600.0).alias("rate"), (named("dead_lettered") / 3600.0).alias("letters"))


@query("behind_count", "WITH" + _HOURS + """
SELECT "at", CAST(sum(CASE WHEN rate > 0 AND lag / rate > 3600 OR rate = 0 AND lag > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_behind, count(*) AS groups FROM hours GROUP BY "at"
""")
def behind_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.behind(_hours(spark, sf_dir))


@query("dead_letter_alerts", "WITH" + _HOURS + """
SELECT group_id AS function_id, "at", round(letters, 6) AS rate, min(CASE WHEN letters > 0.0002 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY "at" ROWS 1 PRECEDING) = 1 AND count(*) OVER (PARTITION BY group_id ORDER BY "at" ROWS 1 PRECEDING) = 2 AS alert FROM hours
""")
def dead_letter_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dead_letter_alerts(_hours(spark, sf_dir).select(F.col("group_id").alias("function_id"), "at", F.col("letters").alias("rate")), 0.0002, 2)


@query("slow_alerts", "WITH" + _HOURS + """
SELECT group_id AS function_id, "at", round(median, 6) AS multiple, min(CASE WHEN median < 25 THEN 1 ELSE 0 END) OVER (PARTITION BY group_id ORDER BY "at" ROWS 2 PRECEDING) = 1 AND count(*) OVER (PARTITION BY group_id ORDER BY "at" ROWS 2 PRECEDING) = 3 AS alert FROM hours
""")
def slow_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.event_log(spark, sf_dir).select("function_id", F.date_trunc("hour", "at").alias("at"), F.col("process_seconds").alias("multiple"))
    return T.slow_alerts(T.quantiles(log, ["function_id", "at"], "multiple", [0.5]).withColumnRenamed("p50", "multiple"), 25.0, 3)


@query("codes_by_frequency", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + " SELECT error_code, count(*) AS n FROM dead GROUP BY error_code ORDER BY n DESC, error_code")
def codes_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.codes_by_frequency(D.dead_letters(spark, sf_dir))


_ENVELOPES = D.RESULTS + """, env AS (
  SELECT *, CASE WHEN l_partkey % 13 <> 0 THEN status WHEN l_partkey % 2 = 0 THEN 'UNSPECIFIED' END AS said, CASE WHEN l_suppkey % 3 = 0 THEN 'p' END AS payload, CASE WHEN l_suppkey % 5 = 0 THEN 'r' END AS payload_ref FROM res
)"""


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which some have an unknown or no status, or both a payload and a reference to one."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    said = F.when(part % 13 != 0, F.col("status")).when(part % 2 == 0, "UNSPECIFIED")
    return D.results(spark, sf_dir).withColumns({"status": said, "payload": F.when(supp % 3 == 0, "p"), "payload_ref": F.when(supp % 5 == 0, "r")})


@query("undecodable_results", "WITH" + _ENVELOPES + """
SELECT function_id, CAST(sum(CASE WHEN said IS NULL OR said = 'UNSPECIFIED' OR (payload IS NOT NULL AND payload_ref IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS undecodable, count(*) AS results FROM env GROUP BY function_id
""")
def undecodable_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.undecodable(_envelopes(spark, sf_dir))


@query("result_round_trip", "WITH" + _ENVELOPES + """
SELECT call_id, function_id, CASE WHEN said IN ('SUCCESS', 'FAILED', 'SKIPPED') THEN said END AS status, attempt, completed_at, coalesce(said NOT IN ('SUCCESS', 'FAILED', 'SKIPPED') OR (payload IS NOT NULL AND payload_ref IS NOT NULL), true) AS undecodable, count(*) AS n
FROM env GROUP BY ALL
""")
def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON messages and back; what is not valid is told apart on reading."""
    back = E.result_of_json(E.result_json(_envelopes(spark, sf_dir)))
    return back.withColumn("undecodable", F.col("error_code").isNotNull()).groupBy("call_id", "function_id", "status", "attempt", "completed_at", "undecodable").agg(F.count("*").alias("n"))


@query("status_mix", "WITH" + D.RESULTS + "SELECT date_trunc('day', completed_at) AS window_start, function_id, function_version, status, count(*) AS n FROM res GROUP BY ALL")
def status_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.status_mix(D.results(spark, sf_dir), "1 day")


@query("outcome_reasons", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + """
SELECT function_id, CASE WHEN retryable AND attempt < 3 THEN 'call.retry_scheduled' ELSE 'call.dead_lettered' END AS event_name, error_code AS reason, count(*) AS n FROM dead GROUP BY ALL
UNION ALL SELECT function_id, 'call.completed', status, count(*) FROM res WHERE status <> 'FAILED' GROUP BY function_id, status
""")
def outcome_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of results and of dead letters, counted by what they say."""
    letters = D.dead_letters(spark, sf_dir).withColumns({"at": F.col("failed_at"), "function_version": F.lit("1.0.0")})
    again = F.col("retryable") & (F.col("attempt") < 3)
    done = D.results(spark, sf_dir).filter("status <> 'FAILED'").withColumn("at", F.col("completed_at"))
    keep = lambda df, c: df.select("at", "call_id", "function_id", "function_version", c)
    events = E.emitted(keep(letters.filter(again), "error_code"), "call.retry_scheduled").unionByName(E.emitted(keep(letters.filter(~again), "error_code"), "call.dead_lettered")).unionByName(E.emitted(keep(done, "status"), "call.completed"))
    return T.outcomes(events, F.coalesce(F.col("attrs")["error_code"], F.col("attrs")["status"]))


@query("events_since", "WITH" + D.EVENT_LOG + """
SELECT event_id, call_id, function_id, event_name, "at" FROM log WHERE event_name IN ('completed', 'dead_lettered') AND "at" > TIMESTAMP '2024-01-20 12:00:00'
""")
def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return T.terminal_events(D.event_log(spark, sf_dir), since, ("completed", "dead_lettered")).select("event_id", "call_id", "function_id", "event_name", "at")


@query("recent_for_function", "WITH" + D.EVENT_LOG + """
SELECT function_id, event_id, event_name, "at", place FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY function_id ORDER BY "at" DESC, event_id DESC) AS INTEGER) AS place FROM log WHERE event_name IN ('completed', 'dead_lettered')) WHERE place <= 10
""")
def recent_for_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.recent_for_function(D.event_log(spark, sf_dir), ["at", "event_id"], 10, ("completed", "dead_lettered")).select("function_id", "event_id", "event_name", "at", "place")


@query("usable_recordings", "SELECT CAST(o_orderkey AS VARCHAR) AS audio_id, CAST(o_orderkey AS VARCHAR) || '.flac' AS filename FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0")
def usable_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "").when(k % 9 != 0, F.concat(k.cast("string"), F.lit(".flac")))
    m = D.table(spark, sf_dir, "orders").select(k.cast("string").alias("audio_id"), F.when(F.col("o_orderstatus") == "F", "hydrates").otherwise("poison").alias("expect"), name.alias("filename"))
    return T.usable_recordings(m).select("audio_id", "filename")


@query("aligned_frames", "WITH" + D.VECTORS + """
SELECT call_id, CAST(i // 4 AS BIGINT) AS frame_idx, round(avg(x * x), 6) AS power, round(max(abs(x)), 6) AS peak FROM sig GROUP BY ALL HAVING count(*) = 4
""")
def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(D.vectors(spark, sf_dir), 4)
    peak = F.aggregate("frame", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    return T.aligned_frames(f.select("call_id", "frame_idx", power().alias("value")), f.select("call_id", "frame_idx", peak.alias("value")), ("power", "peak"))


_TRACED = "('1', '2', '3', '7')"


@query("traced_calls", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + "," + D.REFERENCES + "," + D.DECLARED + f"""
SELECT refs.call_id, true AS hydrated, (SELECT count(DISTINCT function_id) FROM res WHERE res.call_id = refs.call_id) AS n_results, (SELECT count(*) FROM dead WHERE dead.call_id = refs.call_id) AS n_dead,
       (SELECT count(*) FROM decl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id)) AS n_missing
FROM refs WHERE refs.call_id IN {_TRACED}
""")
def traced_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up of four calls; the tables are not laid out by call, so all of their key columns are read (`looked_up_calls` is one that is)."""
    calls = ["1", "2", "3", "7"]
    t = T.trace_of(calls, D.references(spark, sf_dir), D.results(spark, sf_dir), D.dead_letters(spark, sf_dir), D.declared(spark), D.ORDER)
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return t.select("call_id", "hydrated", n("results").alias("n_results"), n("dead_letters").alias("n_dead"), n("missing").alias("n_missing"))


@query("full_report", "WITH" + _ENVELOPES + "," + D.DEAD_LETTERS + "," + D.REFERENCES + "," + D.DECLARED + """, lost AS (SELECT DISTINCT call_id FROM refs WHERE CAST(call_id AS BIGINT) % 10 = 0), t AS (
  SELECT function_id, count(*) AS results, count(DISTINCT env.call_id) AS unique_calls, CAST(sum(CASE WHEN said = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS success, CAST(sum(CASE WHEN said = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
         CAST(sum(CASE WHEN said = 'SKIPPED' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, max(attempt) AS max_attempt, sum(duration_seconds) AS audio_seconds,
         CAST(sum(CASE WHEN said IS NULL OR said = 'UNSPECIFIED' OR (payload IS NOT NULL AND payload_ref IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS undecodable
  FROM env LEFT JOIN refs ON env.call_id = refs.call_id GROUP BY function_id
), d AS (SELECT function_id, count(DISTINCT call_id) AS dlq_calls FROM dead GROUP BY function_id), gone AS (
  SELECT decl.function_id, count(*) AS n_missing, array_to_string(list_slice(list(refs.call_id ORDER BY refs.call_id), 1, 5), ',') AS examples FROM refs, decl
  WHERE refs.call_id NOT IN (SELECT call_id FROM lost) AND NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id) GROUP BY decl.function_id
)
SELECT decl.function_id, coalesce(results, 0) AS results, coalesce(unique_calls, 0) AS unique_calls, coalesce(results - unique_calls, 0) AS duplicates, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped,
       coalesce(dlq_calls, 0) AS dlq_calls, coalesce(undecodable, 0) AS undecodable, coalesce(n_missing, 0) AS n_missing, max_attempt, round(coalesce(audio_seconds, 0), 5) AS audio_seconds, coalesce(examples, '') AS examples,
       (SELECT count(*) FROM refs) AS expected, (SELECT count(*) FROM lost) AS hydration_failures, (SELECT count(*) FROM refs) - (SELECT count(*) FROM lost) AS reachable,
       coalesce(n_missing, 0) = 0 AND coalesce(results - unique_calls, 0) = 0 AND coalesce(undecodable, 0) = 0 AS passed
FROM decl LEFT JOIN t ON decl.function_id = t.function_id LEFT JOIN d ON decl.function_id = d.function_id LEFT JOIN gone ON decl.function_id = gone.function_id
""")
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth call stands for one that was never hydrated."""
    refs = D.references(spark, sf_dir)
    lost = refs.filter(F.col("call_id").cast("long") % 10 == 0).select("call_id", F.lit(C.HYDRATOR).alias("function_id"))
    letters = D.dead_letters(spark, sf_dir).select("call_id", "function_id").unionByName(lost)
    out = T.full_report(refs, _envelopes(spark, sf_dir), letters, D.declared(spark))
    return out.withColumns({"audio_seconds": F.round("audio_seconds", 5), "examples": F.concat_ws(",", "examples")})


@query("multiple_quantiles", "WITH" + D.RESULTS + "," + D.REFERENCES + """, m AS (
  SELECT function_id, function_version, duration_seconds / CAST(l_quantity AS DOUBLE) AS multiple FROM res JOIN refs ON res.call_id = refs.call_id WHERE duration_seconds > 0 AND l_quantity > 0
)
SELECT function_id, function_version, round(quantile_cont(multiple, 0.05), 6) AS p5, round(quantile_cont(multiple, 0.5), 6) AS p50 FROM m GROUP BY ALL
""")
def multiple_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quantiles(T.multiples(D.results(spark, sf_dir), D.references(spark, sf_dir)), ["function_id", "function_version"], "multiple", [0.05, 0.5])


@query("stream_lag", """
SELECT 'g' || CAST(s_suppkey % 50 AS VARCHAR) AS group_id, CAST(sum(greatest(0, 5000 + s_suppkey * 3 - s_suppkey * 2)) AS BIGINT) AS lag, CAST(0 AS BIGINT) AS uncommitted FROM supplier
WHERE s_suppkey IN (SELECT max(s_suppkey) FROM supplier GROUP BY s_suppkey % 50) GROUP BY ALL
""")
def stream_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as progress reports, fifty groups of them; the last of a group counts."""
    k = F.col("s_suppkey")
    at = lambda n: F.to_json(F.create_map(F.lit("calls.internal"), F.create_map(F.lit("0"), n)))
    body = F.to_json(F.struct(k.alias("batchId"), F.array(F.struct(at(k * 2).alias("endOffset"), at(5000 + k * 3).alias("latestOffset"))).alias("sources")))
    return C.group_lag(T.progress_offsets(D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("g"), (k % 50).cast("string")).alias("group_id"), body.alias("json"))))


_GRADES = {"duration_rms": "dbfs", "silence_ratio": "silence_ratio", "clipping_detect": "clipped", "energy_vad": "speech_ratio", "spectral_centroid": "centroid_hz", "spectral_rolloff": "band_limited", "snr_estimate": "snr_db", "zero_crossing_rate": "zcr_per_second"}


@query("payload_grades", """
WITH p AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'duration_rms' WHEN 1 THEN 'silence_ratio' WHEN 2 THEN 'clipping_detect' WHEN 3 THEN 'energy_vad' WHEN 4 THEN 'spectral_centroid' WHEN 5 THEN 'spectral_rolloff' WHEN 6 THEN 'snr_estimate' ELSE 'zero_crossing_rate' END AS f, value AS v FROM events
)
SELECT event_id, f AS function_id,
  CASE f WHEN 'duration_rms' THEN CASE WHEN -v > -3 THEN 'bad' WHEN -v < -50 THEN 'warn' ELSE 'good' END WHEN 'silence_ratio' THEN CASE WHEN v / 100 > 0.6 THEN 'warn' ELSE 'good' END WHEN 'clipping_detect' THEN CASE WHEN v - 50 > 0 THEN 'bad' ELSE 'good' END
         WHEN 'energy_vad' THEN CASE WHEN v / 100 > 0.1 THEN 'good' ELSE 'warn' END WHEN 'spectral_rolloff' THEN CASE WHEN v - 50 > 0 THEN 'warn' ELSE 'good' END WHEN 'snr_estimate' THEN CASE WHEN v / 100 < 0.4 THEN 'warn' WHEN v > 20 THEN 'good' END END AS grade,
  round(CASE f WHEN 'duration_rms' THEN greatest(0, least(1, (-v + 60) / 60)) WHEN 'spectral_centroid' THEN least(1, v * 100 / 8000) WHEN 'zero_crossing_rate' THEN least(1, v * 100 / 4000) END, 6) AS fraction,
  CASE WHEN f = 'duration_rms' THEN CASE WHEN abs(v - 50) > 1 THEN 'bad' ELSE 'good' END END AS claim_grade, CASE WHEN f = 'energy_vad' AND v - 50 < 0 THEN 'never' END AS note
FROM p WHERE v IS NOT NULL
""")
def payload_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads of the eight analyzers in turn."""
    v, names = F.col("value"), list(_GRADES)
    function = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 8 + 1).cast("int"))
    numbers = {"dbfs": -v, "silence_ratio": v / 100, "clipped": v - 50, "speech_ratio": v / 100, "centroid_hz": v * 100, "nyquist_hz": F.lit(8000.0), "band_limited": v - 50, "snr_db": v, "confidence": v / 100, "zcr_per_second": v * 100, "duration_seconds": v, "reference_duration_seconds": F.lit(50.0), "first_speech_seconds": v - 50}
    m = F.create_map(*[x for k, c in numbers.items() for x in (F.lit(k), c)])
    p = D.table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", function.alias("function_id"), m.alias("m"))
    return C.graded(p).select("event_id", "function_id", "grade", "fraction", "claim_grade", "note")


@query("objects_with_fallback", "WITH" + D.REFERENCES + """
SELECT call_id, CASE WHEN CAST(call_id AS BIGINT) % 3 <> 0 THEN 'live' WHEN CAST(call_id AS BIGINT) % 2 = 0 THEN 'archive' END AS "from", CASE WHEN CAST(call_id AS BIGINT) % 3 = 0 AND CAST(call_id AS BIGINT) % 2 <> 0 THEN 'OBJECT_MISSING' END AS error_code FROM refs
""")
def objects_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the objects has expired, half of them are in the archive."""
    refs = D.references(spark, sf_dir)
    k = F.col("call_id").cast("long")
    held = lambda rows, name: rows.select("object_key", F.encode(F.lit(name), "UTF-8").alias("content"))
    found = R.with_fallback(refs, held(refs.filter(k % 3 != 0), "live"), held(refs.filter(k % 2 == 0), "archive"))
    return found.select("call_id", F.decode("content", "UTF-8").alias("from"), "error_code")


@query("required_topics", """
WITH d AS (
  SELECT 'fn_' || CAST(s_suppkey AS VARCHAR) AS subject, s_suppkey AS k, s_suppkey % 9 + 1 AS declared, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 END AS there FROM supplier
)
SELECT severity, message, count(*) AS n, min(subject) AS subject FROM (
  SELECT 'error' AS severity, subject, 'results topic is missing' AS message FROM d WHERE there IS NULL
  UNION ALL SELECT 'error', subject, 'declares more partitions than there are' FROM d WHERE declared > there
  UNION ALL SELECT 'warning', subject, 'declares fewer partitions than there are' FROM d WHERE declared < there
  UNION ALL SELECT 'warning', subject, 'dead-letter topic is missing' FROM d WHERE k % 3 <> 0
  UNION ALL SELECT DISTINCT 'error', 'calls.raw', 'required topic is missing' FROM supplier) GROUP BY severity, message
""")
def required_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind, the raw topic among what must exist."""
    found = C.lint(*suppliers(spark, sf_dir), required=("calls.raw", "calls.internal"))
    return found.groupBy("severity", "message").agg(F.count("*").alias("n"), F.min("subject").alias("subject"))


@query("fetched_recordings", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'AUDIO_NOT_FOUND' WHEN event_id % 5 = 2 THEN 'AUDIO_API_ERROR' END AS error_code, CASE WHEN event_id % 5 > 2 THEN event_type END AS content FROM events
""")
def fetched_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records; a fifth has no recording, others were not found or could not be fetched."""
    e, k = D.table(spark, sf_dir, "events"), F.col("event_id") % 5
    records = e.select("event_id", F.col("event_id").cast("string").alias("audio_id"), F.lit(None).cast("string").alias("error_code"))
    held = e.filter(k > 0).select(F.col("event_id").cast("string").alias("audio_id"), F.when(k > 2, F.encode("event_type", "UTF-8")).alias("content"), F.when(k == 1, 404).when(k == 2, 503).otherwise(200).alias("http_status"))
    return R.fetched(records, held).select("event_id", "error_code", F.decode("content", "UTF-8").alias("content"))


@query("backlog_pages", "WITH" + _HOURS + """, f AS (SELECT group_id, "at", CASE WHEN rate > 0 THEN lag / rate > 10800 WHEN lag > 0 THEN true ELSE false END AS late FROM hours)
SELECT group_id, "at", min(CAST(late AS INTEGER)) OVER (PARTITION BY group_id ORDER BY "at" ROWS 1 PRECEDING) = 1 AND count(*) OVER (PARTITION BY group_id ORDER BY "at" ROWS 1 PRECEDING) = 2 AS page FROM f
""")
def backlog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alerts(_hours(spark, sf_dir), sustained=2).select("group_id", "at", "page")


@query("file_multiples", "WITH" + D.RESULTS + "," + D.REFERENCES + """
SELECT res.call_id, function_id, attempt, CASE WHEN duration_seconds > 0 AND l_quantity > 0 THEN CAST(floor(duration_seconds / CAST(l_quantity AS DOUBLE) * 1000) AS BIGINT) END AS thousandths FROM res JOIN refs ON res.call_id = refs.call_id
""")
def file_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples in whole thousandths, which no engine rounds in its own way."""
    thousandths = F.floor(F.col("multiple") * 1000).alias("thousandths")
    return T.multiples(D.results(spark, sf_dir), D.references(spark, sf_dir)).select("call_id", "function_id", "attempt", thousandths)

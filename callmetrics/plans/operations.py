"""Queries over results, dead letters, events, offsets and declarations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import backoff_seconds, explode_payload, hash_bucket, truncated_bytes
from ..operators import accounting as C
from ..operators import delivery as V
from ..operators import fleet
from ..sources import events as E
from ..sources import records as R
from . import adapters as D
from .analysis import Query, rounded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("latest_results", "WITH" + D.RESULTS + """
SELECT call_id, function_id, function_version, status, attempt, completed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY call_id, function_id, function_version ORDER BY completed_at DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM res) WHERE k = 1
""")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest(D.results(spark, sf_dir), V.KEY, D.ORDER).select(*V.KEY, "status", "attempt", "completed_at")


@query("duplicate_results", "WITH" + D.RESULTS + """
SELECT function_id, count(*) - count(DISTINCT call_id) AS duplicates FROM res GROUP BY function_id
""")
def duplicate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = V.marked_duplicates(D.results(spark, sf_dir), D.ORDER)
    return marked.groupBy("function_id").agg(F.count_if("duplicate").alias("duplicates"))


@query("function_tally", "WITH" + D.RESULTS + """
SELECT function_id, count(*) AS results, count(DISTINCT call_id) AS unique_calls, count(*) - count(DISTINCT call_id) AS duplicates, CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS success,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN status = 'SKIPPED' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, max(attempt) AS max_attempt,
       round(sum(o_totalprice / 1000), 5) AS audio_seconds, min(completed_at) AS first_seen, max(completed_at) AS last_seen, round(count(DISTINCT call_id) / CAST(epoch(max(completed_at)) - epoch(min(completed_at)) AS DOUBLE), 6) AS calls_per_second
FROM res JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders) ON call_id = k GROUP BY function_id
""")
def function_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = D.references(spark, sf_dir).select("call_id", F.col("duration_seconds").alias("seconds"))
    return C.function_tally(D.results(spark, sf_dir), audio).withColumn("audio_seconds", F.round("audio_seconds", 5))


@query("latency_percentiles", "WITH" + D.RESULTS + """, v AS (
  SELECT function_id, CAST(l_quantity AS DOUBLE) AS q, row_number() OVER (PARTITION BY function_id ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY function_id) AS n FROM res
)
SELECT function_id, max(CASE WHEN i = least(n - 1, CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) THEN q END) AS p50, max(CASE WHEN i = least(n - 1, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) THEN q END) AS p95 FROM v GROUP BY function_id
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.results(spark, sf_dir).withColumn("seconds", C.seconds_between("started_at", "completed_at"))
    return fleet.nearest_ranks(r, ["function_id"], "seconds", [50, 95])


@query("realtime_multiple", "WITH" + D.RESULTS + "," + D.REFERENCES + """
SELECT function_id, round(sum(duration_seconds) / sum(CAST(l_quantity AS DOUBLE)), 4) AS multiple, sum(duration_seconds) / sum(CAST(l_quantity AS DOUBLE)) >= 5 AS meets_floor FROM res JOIN refs ON res.call_id = refs.call_id GROUP BY function_id
""")
def realtime_multiple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.realtime_multiple(D.results(spark, sf_dir), D.references(spark, sf_dir), 5.0).withColumn("multiple", F.round("multiple", 4))


@query("dead_letters_by_code", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + """
SELECT function_id, error_code, count(*) AS n, count(DISTINCT call_id) AS calls FROM dead GROUP BY function_id, error_code
""")
def dead_letters_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dead_letters_by_code(D.dead_letters(spark, sf_dir))


@query("newest_dead_letters", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + """
SELECT call_id, function_id, error_code, failed_at FROM dead ORDER BY failed_at DESC, call_id, function_id, l_partkey, l_suppkey LIMIT 100
""")
def newest_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.dead_letters(spark, sf_dir).orderBy(F.desc("failed_at"), "call_id", "function_id", "l_partkey", "l_suppkey").limit(100)
    return d.select("call_id", "function_id", "error_code", "failed_at")


@query("outcome_counters", "WITH" + D.EVENT_LOG + " SELECT function_id, event_name, count(*) AS n FROM log GROUP BY function_id, event_name")
def outcome_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outcome_counters(D.event_log(spark, sf_dir))


@query("retry_routes", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + """
SELECT function_id, CASE WHEN retryable AND attempt < 3 THEN 'RETRY' ELSE 'DLQ' END AS route, attempt, count(*) AS n, least(2.0 * pow(2, attempt - 1), 5.0) AS delay_seconds FROM dead GROUP BY ALL
""")
def retry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = V.routed(D.dead_letters(spark, sf_dir).withColumn("retry_budget", F.lit(3)))
    delay = backoff_seconds(F.col("attempt"), F.lit(2.0), F.lit(5.0))
    return routed.groupBy("function_id", "route", "attempt").agg(F.count("*").alias("n")).withColumn("delay_seconds", delay)


@query("missing_functions", "WITH" + D.RESULTS + "," + D.REFERENCES + "," + D.DECLARED + """
SELECT refs.call_id, decl.function_id FROM refs, decl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id)
""")
def missing_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.missing(D.references(spark, sf_dir), D.declared(spark), V.answered(D.results(spark, sf_dir), D.dead_letters(spark, sf_dir)))


@query("call_trace", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + "," + D.REFERENCES + "," + D.DECLARED + """, r AS (
  SELECT call_id, count(DISTINCT function_id) AS n_results FROM res GROUP BY call_id
), d AS (
  SELECT call_id, count(*) AS n_dead FROM dead GROUP BY call_id
), m AS (
  SELECT refs.call_id, string_agg(decl.function_id, ',' ORDER BY decl.function_id) AS missing FROM refs, decl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id) GROUP BY refs.call_id
)
SELECT refs.call_id, true AS hydrated, coalesce(n_results, 0) AS n_results, coalesce(n_dead, 0) AS n_dead, coalesce(missing, '') AS missing, missing IS NULL AS complete
FROM refs LEFT JOIN r ON refs.call_id = r.call_id LEFT JOIN d ON refs.call_id = d.call_id LEFT JOIN m ON refs.call_id = m.call_id
""")
def call_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.call_trace(D.references(spark, sf_dir), D.results(spark, sf_dir), D.dead_letters(spark, sf_dir), D.declared(spark), D.ORDER)
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return t.select("call_id", "hydrated", n("results").alias("n_results"), n("dead_letters").alias("n_dead"), F.concat_ws(",", "missing").alias("missing"), "complete")


@query("drift", "WITH" + D.EVENT_LOG + "," + D.DECLARED + """, run AS (SELECT DISTINCT function_id FROM log)
SELECT function_id, 'undeclared' AS drift FROM run WHERE function_id NOT IN (SELECT function_id FROM decl) UNION ALL SELECT function_id, 'not_running' AS drift FROM decl WHERE function_id NOT IN (SELECT function_id FROM run)
""")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drift(D.declared(spark), D.event_log(spark, sf_dir))


def suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as declarations, and the topics of every second and third of them, with a number of partitions by nation."""
    n, key = D.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = lambda kind: F.concat(F.lit(f"calls.{kind}."), key.cast("string"))
    d = n.select(F.concat(F.lit("fn_"), key.cast("string")).alias("function_id"), F.lit("calls.internal").alias("input_topic"), name("results").alias("results_topic"), (key % 9 + 1).cast("int").alias("results_topic_partitions"), name("dlq").alias("dlq_topic"))
    results = n.filter(key % 2 == 0).select(name("results").alias("name"), (F.col("s_nationkey") + 1).cast("int").alias("partitions"))
    dlq = n.filter(key % 3 == 0).select(name("dlq").alias("name"), F.lit(3).alias("partitions"))
    return d, results.union(dlq).union(n.select(F.lit("calls.internal"), F.lit(200)).distinct())


@query("config_lint", """
WITH d AS (
  SELECT 'fn_' || CAST(s_suppkey AS VARCHAR) AS subject, s_suppkey AS k, s_suppkey % 9 + 1 AS declared, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 END AS there FROM supplier
)
SELECT 'error' AS severity, subject, 'results topic is missing' AS message FROM d WHERE there IS NULL
UNION ALL SELECT 'error', subject, 'declares more partitions than there are' FROM d WHERE declared > there
UNION ALL SELECT 'warning', subject, 'declares fewer partitions than there are' FROM d WHERE declared < there
UNION ALL SELECT 'warning', subject, 'dead-letter topic is missing' FROM d WHERE k % 3 <> 0
""")
def config_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lint(*suppliers(spark, sf_dir))


@query("topic_plan", """
SELECT 'calls.raw' AS name, 12 AS partitions UNION ALL SELECT 'calls.internal', CAST(max(s_suppkey % 9 + 1) AS INTEGER) FROM supplier
UNION ALL SELECT 'calls.results.' || CAST(s_suppkey AS VARCHAR), CAST(s_suppkey % 9 + 1 AS INTEGER) FROM supplier UNION ALL SELECT 'calls.dlq.' || CAST(s_suppkey AS VARCHAR), 3 FROM supplier
""")
def topic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.topic_plan(suppliers(spark, sf_dir)[0])


@query("group_lag", "WITH" + D.OFFSETS + """
SELECT group_id, CAST(sum(greatest(0, CASE WHEN committed < 0 THEN high - low ELSE high - committed END)) AS BIGINT) AS lag, CAST(sum(CASE WHEN committed < 0 THEN 1 ELSE 0 END) AS BIGINT) AS uncommitted FROM off GROUP BY group_id
""")
def group_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.group_lag(D.offsets(spark, sf_dir))


@query("function_registry", "WITH" + D.OFFSETS + "," + D.DECLARED + """, g AS (
  SELECT group_id, CAST(sum(greatest(0, CASE WHEN committed < 0 THEN high - low ELSE high - committed END)) AS BIGINT) AS lag FROM off GROUP BY group_id
)
SELECT function_id, group_id, lag FROM decl LEFT JOIN g ON split_part(group_id, ':', 1) = function_id
""")
def function_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.registry(D.declared(spark), C.group_lag(D.offsets(spark, sf_dir))).select("function_id", "group_id", "lag")


@query("replayed_letters", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + """
SELECT dead.call_id, dead.function_id, error_code FROM dead JOIN (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS call_id FROM orders WHERE o_orderpriority = '1-URGENT') q ON dead.call_id = q.call_id
""")
def replayed_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = D.dead_letters(spark, sf_dir).select("call_id", "function_id", F.lit(0).alias("source_partition"), F.col("call_id").cast("long").alias("source_offset"), F.lit("calls.internal").alias("source_topic"), F.encode("call_id", "UTF-8").alias("key"), F.encode("error_code", "UTF-8").alias("body"))
    urgent = D.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("long").alias("source_offset"), F.lit(0).alias("source_partition"))
    requests = urgent.withColumn("function_id", F.explode(F.array(*[F.lit(f"fn_{i}") for i in range(1, 8)])))
    return V.replays(letters, requests).select("call_id", "function_id", F.decode("value", "UTF-8").alias("error_code"))


@query("unaccounted_calls", "WITH" + D.RESULTS + "," + D.REFERENCES + "," + D.DECLARED + """, gone AS (
  SELECT decl.function_id, refs.call_id FROM refs, decl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id)
)
SELECT function_id, count(*) AS n_missing, array_to_string(list_slice(list(call_id ORDER BY call_id), 1, 5), ',') AS examples FROM gone GROUP BY function_id
""")
def unaccounted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = D.references(spark, sf_dir).select("call_id").limit(0)
    u = C.unaccounted(D.references(spark, sf_dir), none, V.answered(D.results(spark, sf_dir), D.dead_letters(spark, sf_dir)), D.declared(spark))
    return u.withColumn("examples", F.concat_ws(",", "examples"))


@query("accounting_report", "WITH" + D.RESULTS + "," + D.DEAD_LETTERS + "," + D.REFERENCES + "," + D.DECLARED + """, t AS (
  SELECT function_id, count(*) AS results, count(DISTINCT call_id) AS unique_calls FROM res GROUP BY function_id
), d AS (SELECT function_id, count(DISTINCT call_id) AS dlq_calls FROM dead GROUP BY function_id), gone AS (
  SELECT decl.function_id, count(*) AS n_missing FROM refs, decl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.call_id = refs.call_id AND res.function_id = decl.function_id) GROUP BY decl.function_id
)
SELECT decl.function_id, coalesce(results, 0) AS results, coalesce(unique_calls, 0) AS unique_calls, coalesce(results - unique_calls, 0) AS duplicates, coalesce(dlq_calls, 0) AS dlq_calls, coalesce(n_missing, 0) AS n_missing,
       coalesce(n_missing, 0) = 0 AND coalesce(results - unique_calls, 0) = 0 AS passed
FROM decl LEFT JOIN t ON decl.function_id = t.function_id LEFT JOIN d ON decl.function_id = d.function_id LEFT JOIN gone ON decl.function_id = gone.function_id
""")
def accounting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.report(D.references(spark, sf_dir), D.results(spark, sf_dir), D.dead_letters(spark, sf_dir), D.declared(spark)).drop("examples")


@query("version_diff", """
WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS call_id, l_linenumber AS n, CAST(max(l_extendedprice) AS DOUBLE) AS m FROM lineitem GROUP BY ALL)
SELECT coalesce(a.call_id, b.call_id) AS call_id, round(a.m, 6) AS old, round(b.m, 6) AS new, CASE WHEN b.call_id IS NULL THEN 'only_old' WHEN a.call_id IS NULL THEN 'only_new' WHEN abs(a.m - b.m) <= 10000 THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM v WHERE n = 1) a FULL OUTER JOIN (SELECT * FROM v WHERE n = 2) b ON a.call_id = b.call_id
""")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").cast("double").alias("m"))
    r = item.select(F.col("l_orderkey").cast("string").alias("call_id"), F.lit("price").alias("function_id"), F.col("l_linenumber").cast("string").alias("function_version"), "m")
    return V.version_diff(r, "price", "1", "2", F.col("m"), 10000.0)


@query("duration_disagreement", """
WITH m AS (SELECT l_orderkey AS k, CAST(sum(l_extendedprice) AS DOUBLE) / 1000 AS measured FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS call_id, round(measured - nullif(CAST(o_totalprice AS DOUBLE) / 1000, 0), 5) AS disagreement, coalesce(abs(measured - nullif(CAST(o_totalprice AS DOUBLE) / 1000, 0)) > 1, false) AS flagged FROM orders LEFT JOIN m ON o_orderkey = k
""")
def duration_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = D.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_extendedprice").cast("double") / 1000).alias("duration_seconds"))
    r = measured.select(F.col("l_orderkey").cast("string").alias("call_id"), F.lit("duration_rms").alias("function_id"), F.lit("1.0.0").alias("function_version"), F.to_json(F.struct("duration_seconds")).alias("payload"))
    return V.duration_disagreement(r, D.references(spark, sf_dir)).withColumn("disagreement", F.round("disagreement", 5))


@query("hydrated_calls", "WITH" + D.EVENT_LOG + """
SELECT call_id, max(CASE WHEN (function_id = 'fn_0' AND event_name = 'completed') OR (function_id <> 'fn_0' AND event_name = 'received') THEN 1 ELSE 0 END) = 1 AS hydrated FROM log GROUP BY call_id
""")
def hydrated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.event_log(spark, sf_dir).withColumns({"function_id": F.when(F.col("function_id") == "fn_0", C.HYDRATOR).otherwise(F.col("function_id")), "event_name": F.concat(F.lit("call."), "event_name")})
    return C.hydrated_calls(log)


@query("recent_events", "WITH" + D.EVENT_LOG + """
SELECT event_id, call_id, function_id, event_name, "at" FROM log WHERE event_name IN ('completed', 'dead_lettered') ORDER BY "at" DESC, event_id DESC LIMIT 40
""")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.event_log(spark, sf_dir).filter(F.col("event_name").isin("completed", "dead_lettered"))
    return log.orderBy(F.desc("at"), F.desc("event_id")).limit(40).select("event_id", "call_id", "function_id", "event_name", "at")


@query("in_flight", "WITH" + D.EVENT_LOG + """, s AS (
  SELECT function_id, date_trunc('second', "at") AS second, CAST(sum(CASE WHEN event_name = 'received' THEN 1 WHEN event_name IN ('completed', 'dead_lettered') THEN -1 ELSE 0 END) AS BIGINT) AS change FROM log GROUP BY ALL
)
SELECT function_id, second, change, CAST(sum(change) OVER (PARTITION BY function_id ORDER BY second) AS BIGINT) AS depth FROM s
""")
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_flight(D.event_log(spark, sf_dir))


@query("hourly_rates", "WITH" + D.EVENT_LOG + """
SELECT date_trunc('hour', "at") AS window_start, function_id, event_name, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second FROM log GROUP BY ALL
""")
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rates(D.event_log(spark, sf_dir), "1 hour")


@query("sliding_rates", "WITH" + D.EVENT_LOG + """, w AS (
  SELECT date_trunc('hour', "at") - unnest(range(0, 3)) * INTERVAL 1 HOUR AS window_start, function_id, event_name FROM log
)
SELECT window_start, function_id, event_name, count(*) AS n, round(count(*) / 10800.0, 6) AS per_second FROM w GROUP BY ALL
""")
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rates(D.event_log(spark, sf_dir), "3 hours", "1 hour")


@query("backlog_alerts", "WITH" + D.EVENT_LOG + """, s AS (
  SELECT function_id AS group_id, date_trunc('hour', "at") AS "at", CAST(sum(CASE WHEN event_name = 'received' THEN 600 ELSE 0 END) AS BIGINT) AS lag, CAST(sum(CASE WHEN event_name = 'completed' THEN 1 ELSE 0 END) AS BIGINT) / 3600.0 AS rate FROM log GROUP BY ALL
), f AS (
  SELECT group_id, "at", lag, rate, CASE WHEN rate > 0 THEN lag / rate > 3600 WHEN lag > 0 THEN true ELSE false END AS late, lag > 0 AND rate = 0 AS stuck FROM s
)
SELECT group_id, "at", min(CAST(late AS INTEGER)) OVER (PARTITION BY group_id ORDER BY "at" ROWS 2 PRECEDING) = 1 AND count(*) OVER (PARTITION BY group_id ORDER BY "at" ROWS 2 PRECEDING) = 3 AS warn,
       min(CAST(stuck AS INTEGER)) OVER (PARTITION BY group_id ORDER BY "at" ROWS 4 PRECEDING) = 1 AND count(*) OVER (PARTITION BY group_id ORDER BY "at" ROWS 4 PRECEDING) = 5 AS stalled
FROM f
""")
def backlog_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.event_log(spark, sf_dir)
    s = log.groupBy(F.col("function_id").alias("group_id"), F.date_trunc("hour", "at").alias("at")).agg((600 * F.count_if(F.col("event_name") == "received")).alias("lag"), (F.count_if(F.col("event_name") == "completed") / 3600.0).alias("rate"))
    return C.alerts(s, sustained=3).select("group_id", "at", "warn", "stalled")


@query("retry_ladder", "WITH" + D.EVENT_LOG + """, l AS (
  SELECT call_id, function_id, list(event_name ORDER BY "at", event_id) AS e FROM log GROUP BY call_id, function_id
)
SELECT call_id, function_id, array_to_string(e, '>') AS ladder, e[len(e)] IN ('completed', 'dead_lettered') AS terminal FROM l
""")
def retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.retry_ladder(D.event_log(spark, sf_dir), ["at", "event_id"]).withColumn("ladder", F.concat_ws(">", "ladder"))


@query("processing_quantiles", "WITH" + D.EVENT_LOG + """
SELECT function_id, round(quantile_cont(process_seconds, 0.5), 6) AS p50, round(quantile_cont(process_seconds, 0.95), 6) AS p95, round(quantile_cont(process_seconds, 0.99), 6) AS p99 FROM log GROUP BY function_id
""")
def processing_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.quantiles(D.event_log(spark, sf_dir), ["function_id"], "process_seconds", [0.5, 0.95, 0.99])


@query("cohorts", """
SELECT CAST(o_orderkey AS VARCHAR) AS call_id, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) < '33' AS in_fifth FROM orders
""")
def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 0x33 / 256 is just under a fifth; the buckets between the two are told apart by the first byte.
    return D.references(spark, sf_dir).select("call_id", (hash_bucket(F.col("call_id")) < 0x33 / 256).alias("in_fifth"))


@query("flac_headers", """
SELECT CAST(o_orderkey AS VARCHAR) AS call_id, CASE WHEN o_orderkey % 5 = 0 THEN 44100 ELSE 16000 END AS sample_rate, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS channels, 16 AS bits_per_sample,
       CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey * 1000 END AS total_samples, round(CASE WHEN o_orderkey % 11 = 0 OR o_orderkey = 0 THEN NULL ELSE o_orderkey * 1000 / CASE WHEN o_orderkey % 5 = 0 THEN 44100.0 ELSE 16000.0 END END, 6) AS duration_seconds,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey = 0 THEN 'AUDIO_NO_DURATION' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'AUDIO_NOT_CANONICAL' END AS error_code
FROM orders
""")
def flac_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers are packed from order keys, then read."""
    k = F.col("o_orderkey").cast("long")
    rate, channels, total = F.when(k % 5 == 0, 44100).otherwise(16000), F.when(k % 7 == 0, 2).otherwise(1), F.when(k % 11 == 0, 0).otherwise(k * 1000)
    packed = F.shiftleft(rate.cast("long"), 44).bitwiseOR(F.shiftleft((channels - 1).cast("long"), 41)).bitwiseOR(F.shiftleft(F.lit(15).cast("long"), 36)).bitwiseOR(total.cast("long"))
    head = F.concat(F.lit("664C614380000022" + "00" * 10), F.lpad(F.hex(packed), 16, "0"), F.lit("00" * 16))
    df = D.table(spark, sf_dir, "orders").select(k.cast("string").alias("call_id"), F.unhex(head).alias("content"))
    return R.canonical_gate(df.withColumns(R.streaminfo())).drop("content", "header_error")


@query("not_audio", "SELECT page_id, 'AUDIO_NOT_FLAC' AS error_code FROM pages")
def not_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = D.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return R.canonical_gate(df.withColumns(R.streaminfo())).select("page_id", "error_code")


@query("decoded_records", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS call_id, CASE WHEN event_id % 4 <> 0 THEN event_type END AS audio_id, CASE WHEN event_id % 4 = 0 THEN 'DECODE_ERROR' END AS error_code FROM events
""")
def decoded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call records; every fourth is its raw properties, which have no ids."""
    e = D.table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("user_id").cast("string").alias("call_id"), F.col("event_type").alias("audio_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ingested_at"), "props"))
    raw = F.encode(F.when(F.col("event_id") % 4 == 0, F.col("props")).otherwise(good), "UTF-8")
    return R.decoded(e.select("event_id", raw.alias("raw"))).select("event_id", "call_id", "audio_id", "error_code")


@query("claim_checks", """
SELECT page_id, coalesce(octet_length(encode(html)) >= 2048, false) AS by_reference, CASE WHEN octet_length(encode(html)) >= 2048 THEN 'results/pages/1.0.0/' || CAST(page_id AS VARCHAR) END AS payload_ref, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages
""")
def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as payloads; those of 2048 bytes and more are put aside and found again."""
    r = D.table(spark, sf_dir, "pages").select("page_id", F.col("page_id").cast("string").alias("call_id"), F.lit("pages").alias("function_id"), F.lit("1.0.0").alias("function_version"), F.lit("SUCCESS").alias("status"), F.col("html").alias("payload"), F.lit(None).cast("string").alias("payload_ref"))
    checked = V.claim_checked(r, 2048)
    aside = checked.filter("large_payload IS NOT NULL").select("payload_ref", "large_payload")
    back = V.resolved(checked, aside)
    return back.select("page_id", F.col("payload_ref").isNotNull().alias("by_reference"), "payload_ref", F.octet_length("payload").cast("long").alias("size"))


@query("payload_fields", """
SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value, CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS fraction FROM events
""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_payload(D.table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "field", "value", "fraction")


@query("normalised_events", "SELECT event_id, event_type AS event_name, CAST(user_id AS VARCHAR) AS call_id FROM events")
def normalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the events are logged with dotted, half with nested keys."""
    call = F.col("user_id").cast("string").alias("call_id")
    dotted, nested = F.to_json(F.struct(F.col("event_type").alias("event.name"), call)), F.to_json(F.struct(F.struct(F.col("event_type").alias("name")).alias("event"), call))
    logs = D.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, dotted).otherwise(nested).alias("attributes"))
    return E.normalised(logs).select("event_id", "event_name", "call_id")


@query("reference_round_trip", "WITH" + D.REFERENCES + " SELECT call_id, object_key, round(duration_seconds, 6) AS duration_seconds, 16000 AS sample_rate, ingested_at, CAST(NULL AS VARCHAR) AS error_code FROM refs")
def reference_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    r = D.references(spark, sf_dir).withColumns({"envelope_version": F.lit(1), "sample_rate": null("int"), "channels": F.lit(1), "hydrated_at": null("timestamp"), "source_metadata": null("binary")})
    return E.reference_of_json(E.reference_json(r)).select("call_id", "object_key", "duration_seconds", "sample_rate", "ingested_at", "error_code")


@query("error_messages", "SELECT event_id, substr(repeat(event_type || ' ', 200), 1, 1024) AS error_message FROM events")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.repeat(F.concat("event_type", F.lit(" ")), 200)
    return D.table(spark, sf_dir, "events").select("event_id", truncated_bytes(long).alias("error_message"))


@query("graded_levels", """
SELECT vec_id AS call_id, CASE WHEN 10 * log10(m) > -3 THEN 'bad' WHEN 10 * log10(m) < -50 THEN 'warn' ELSE 'good' END AS grade, round(greatest(0, least(1, (10 * log10(m) + 60) / 60)), 6) AS fraction
FROM (SELECT vec_id, avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS m FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id)
""")
def graded_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.analyzers import duration_rms

    p = duration_rms(D.vectors(spark, sf_dir)).select("call_id", F.lit("duration_rms").alias("function_id"), F.create_map(F.lit("dbfs"), "dbfs").alias("m"))
    return C.graded(p).select("call_id", "grade", "fraction")


@query("erased_results", "WITH" + D.RESULTS + """
SELECT count(*) AS kept, count(DISTINCT call_id) AS calls FROM res WHERE call_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')
""")
def erased_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = D.table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("call_id"))
    return V.erased(D.results(spark, sf_dir), gone).agg(F.count("*").alias("kept"), F.countDistinct("call_id").alias("calls"))


@query("tombstones", "WITH" + D.RESULTS + """
SELECT DISTINCT call_id, function_id, function_version, call_id || ':' || function_id || ':' || function_version AS result_key FROM res WHERE call_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')
""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = D.table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("string").alias("call_id"))
    return V.tombstones(gone, D.results(spark, sf_dir))


@query("unanswered_turns", """
WITH roles AS (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL), calls AS (SELECT DISTINCT conv_id FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS call_id, roles.role AS function_id FROM calls, roles WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = calls.conv_id AND c.role = roles.role)
""")
def unanswered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("call_id"), F.col("role").alias("function_id"))
    return V.missing(c, c.filter("function_id IS NOT NULL").select("function_id").distinct(), c.distinct())

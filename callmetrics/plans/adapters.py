"""The driver's tables seen as recordings, references, results, dead letters, events and offsets.

Each adapter has its twin in SQL; a query's SQL begins with the adapters that it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signals import blocked, from_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings of 64 samples at 64 Hz, in blocks of 32."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("call_id"), F.lit(64).alias("sample_rate"), F.col("embedding").cast("array<float>").alias("samples"))
    return blocked(e, 32)


VECTORS = """
sig AS (
  SELECT vec_id AS call_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings
)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, in order, as a recording at 16 Hz."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.lit(16).alias("sample_rate"), "ts", "event_id", ((F.col("value") - 50) / 100).cast("float").alias("value"))
    return from_rows(e, ["ts", "event_id"], 1 << 12)


ACTIVITY = """
sig AS (
  SELECT user_id AS call_id, CAST(CAST((value - 50) / 100 AS FLOAT) AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events
)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("call_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".flac")).alias("object_key"),
        (F.col("o_totalprice").cast("double") / 1000).alias("duration_seconds"), F.col("o_orderdate").cast("timestamp").alias("ingested_at"),
    )


REFERENCES = """
refs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS call_id, CAST(o_orderkey AS VARCHAR) || '.flac' AS object_key, CAST(o_totalprice AS DOUBLE) / 1000 AS duration_seconds, CAST(o_orderdate AS TIMESTAMP) AS ingested_at FROM orders
)"""
ORDER = ["completed_at", "l_partkey", "l_suppkey", "l_extendedprice"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as results; several lines of an order with one number are redeliveries."""
    done = F.col("l_shipdate").cast("timestamp")
    status = F.when(F.col("l_returnflag") == "R", "SUCCESS").when(F.col("l_returnflag") == "A", "FAILED").otherwise("SKIPPED")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("call_id"), F.concat(F.lit("fn_"), F.col("l_linenumber").cast("string")).alias("function_id"), F.lit("1.0.0").alias("function_version"), status.alias("status"),
        (1 + F.col("l_linenumber") % 3).cast("int").alias("attempt"), done.alias("completed_at"), (done.cast("long") - F.col("l_quantity").cast("long")).cast("timestamp").alias("started_at"),
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus",
    )


RESULTS = """
res AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS call_id, 'fn_' || CAST(l_linenumber AS VARCHAR) AS function_id, '1.0.0' AS function_version,
         CASE l_returnflag WHEN 'R' THEN 'SUCCESS' WHEN 'A' THEN 'FAILED' ELSE 'SKIPPED' END AS status,
         CAST(1 + l_linenumber % 3 AS INTEGER) AS attempt, CAST(l_shipdate AS TIMESTAMP) AS completed_at, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linestatus
  FROM lineitem
)"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).filter("status = 'FAILED'")
    late = F.col("l_linestatus") == "O"
    return r.select(
        "call_id", "function_id", F.when(late, "TIMEOUT").otherwise("DECODE_ERROR").alias("error_code"), late.alias("retryable"), "attempt", F.col("completed_at").alias("failed_at"), "l_partkey", "l_suppkey", "l_extendedprice"
    )


DEAD_LETTERS = """
dead AS (
  SELECT call_id, function_id, CASE l_linestatus WHEN 'O' THEN 'TIMEOUT' ELSE 'DECODE_ERROR' END AS error_code, l_linestatus = 'O' AS retryable, attempt, completed_at AS failed_at, l_partkey, l_suppkey, l_extendedprice FROM res WHERE status = 'FAILED'
)"""


def declared(spark: SparkSession) -> DataFrame:
    """Eight functions, the last of which never answers."""
    return spark.range(1, 9).select(F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("function_id"))


DECLARED = """
decl AS (SELECT 'fn_' || CAST(i AS VARCHAR) AS function_id FROM (SELECT unnest(range(1, 9)) AS i))"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("event_type")
    event = F.when(name == "signup", "received").when(name == "purchase", "completed").when(name == "error", "failed").when(name == "view", "retry_scheduled").otherwise("dead_lettered")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("user_id").cast("string").alias("call_id"), F.concat(F.lit("fn_"), (k % 5).cast("string")).alias("function_id"), event.alias("event_name"), F.col("value").alias("process_seconds"))


EVENT_LOG = """
log AS (
  SELECT event_id, ts AS "at", CAST(user_id AS VARCHAR) AS call_id, 'fn_' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS function_id,
         CASE event_type WHEN 'signup' THEN 'received' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'retry_scheduled' ELSE 'dead_lettered' END AS event_name, value AS process_seconds
  FROM events
)"""


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts as partitions' offsets of groups."""
    s = table(spark, sf_dir, "supplier")
    key, nation, cents = F.col("s_suppkey"), F.col("s_nationkey"), F.abs(F.col("s_acctbal").cast("double")).cast("long")
    return s.select(F.concat(F.lit("fn_"), nation.cast("string"), F.lit(":1.0.0")).alias("group_id"), (key % 12).cast("int").alias("partition"), F.when(key % 7 == 0, -1).otherwise(cents).cast("long").alias("committed"), F.lit(10).cast("long").alias("low"), (F.lit(5000) + key * 3).cast("long").alias("high"))


OFFSETS = """
off AS (
  SELECT 'fn_' || CAST(s_nationkey AS VARCHAR) || ':1.0.0' AS group_id, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE CAST(trunc(abs(CAST(s_acctbal AS DOUBLE))) AS BIGINT) END AS committed, 10 AS low, 5000 + s_suppkey * 3 AS high FROM supplier
)"""

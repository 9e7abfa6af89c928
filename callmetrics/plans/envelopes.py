"""Queries on envelopes, headers and ids whose rows differ in what can go wrong, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dashed, same_id, tidy
from ..sources import events as E
from ..sources import records as R
from .adapters import table


def gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by the gate's answer: each order's has another fault in its header, or none."""
    k = F.col("o_orderkey").cast("long")
    stream = F.lpad(F.hex(F.shiftleft(F.lit(16000).cast("long"), 44).bitwiseOR(F.shiftleft(F.lit(15).cast("long"), 36)).bitwiseOR(k)), 16, "0")
    head = lambda magic, kind, length: F.concat(F.lit(magic), F.lit(kind), F.lit(length), F.lit("00" * 10), stream, F.lit("00" * 16))
    whole = head("664C6143", "80", "000022")
    cases = [whole, head("664C6144", "80", "000022"), head("664C6143", "81", "000022"), head("664C6143", "00", "000023"), F.substring(whole, 1, 60), F.substring(whole, 1, 10), F.concat(F.substring(whole, 1, 37), F.lit("4"), F.substring(whole, 39, 100)), F.lit("")]
    content = F.unhex(F.element_at(F.array(*cases), (k % 8 + 1).cast("int")))
    df = table(spark, sf_dir, "orders").select(k.alias("order"), F.when(k % 9 != 0, content).alias("content"))
    return R.canonical_gate(df.withColumns(R.streaminfo())).select("order", "header_error", "total_samples", "error_code")


def reference_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of messages that lack this and that: defaults, and what cannot be read."""
    k = F.col("o_orderkey").cast("long")
    drop = lambda n, c: F.when(k % n != 0, c)
    body = F.to_json(F.struct(drop(2, F.lit(2)).alias("envelope_version"), F.when(k % 7 == 1, "").otherwise(drop(5, k.cast("string"))).alias("call_id"), drop(3, F.lit(8000)).alias("sample_rate"), drop(4, k.cast("double")).alias("duration_seconds")))
    value = F.when(k % 11 == 0, F.substring(body, 1, 7)).otherwise(body)
    df = table(spark, sf_dir, "orders").select(value.alias("value"))
    back = E.reference_of_json(df)
    return back.groupBy("envelope_version", "sample_rate", "error_code").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"), F.count("call_id").alias("ids"))


def payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as payloads of bytes, of which some are no text: through JSON and back as bytes, and whether they can be read as text."""
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("ff00fe")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    df = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("call_id"), F.lit("f").alias("function_id"), F.lit("1").alias("function_version"), F.lit("SUCCESS").alias("status"), raw.alias("payload"), F.lit(None).cast("string").alias("payload_ref"))
    messages = E.result_json(df)
    read = E.result_of_json(messages, payload="bytes").select("call_id", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    text = E.result_of_json(messages).select("call_id", F.col("error_code"))
    return read.join(text, "call_id")


def tidy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as users type them, and the names that follow from ids."""
    kind = F.replace("p_name", F.lit(" "), F.lit("_"))
    typed = F.when(F.col("p_partkey") % 4 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.upper(kind), F.lit("\n")))
    return table(spark, sf_dir, "part").select("p_partkey", dashed(F.lower(kind)).alias("name"), tidy(typed).alias("typed"), same_id(typed, F.lower(kind)).alias("same"))


QUERIES = {"gate_codes": gate_codes, "reference_defaults": reference_defaults, "payload_bytes": payload_bytes, "tidy_ids": tidy_ids}
SQL = {
    "gate_codes": """
WITH k AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 7 ELSE o_orderkey % 8 END AS c FROM orders)
SELECT CAST(k AS BIGINT) AS "order", CASE c WHEN 0 THEN NULL WHEN 1 THEN 'missing magic' WHEN 2 THEN 'first block is not stream info' WHEN 3 THEN 'wrong length' WHEN 4 THEN 'truncated' WHEN 5 THEN 'truncated' WHEN 6 THEN NULL ELSE 'missing magic' END AS header_error,
       CASE WHEN c IN (0, 6) THEN CAST(k AS BIGINT) END AS total_samples,
       CASE WHEN c IN (0, 6) THEN CASE WHEN k = 0 THEN 'AUDIO_NO_DURATION' WHEN c = 6 THEN 'AUDIO_NOT_CANONICAL' END ELSE 'AUDIO_NOT_FLAC' END AS error_code
FROM k
""",
    "reference_defaults": """
WITH k AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 11 = 0 AS torn FROM orders), r AS (
  SELECT CASE WHEN torn OR k % 2 = 0 THEN 1 ELSE 2 END AS envelope_version, CASE WHEN torn OR k % 3 = 0 THEN 16000 ELSE 8000 END AS sample_rate,
         CASE WHEN torn THEN NULL WHEN k % 7 = 1 THEN '' WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) END AS call_id, CASE WHEN torn OR k % 4 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS duration_seconds
  FROM k
)
SELECT envelope_version, sample_rate, CASE WHEN coalesce(call_id, '') = '' THEN 'DECODE_ERROR' END AS error_code, count(*) AS n, sum(duration_seconds) AS seconds, count(call_id) AS ids FROM r GROUP BY ALL
""",
    "payload_bytes": """
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '\\xFF\\x00\\xFE'::BLOB || encode(html) ELSE encode(html) END AS raw FROM pages)
SELECT CAST(page_id AS VARCHAR) AS call_id, CAST(octet_length(raw) AS BIGINT) AS size, sha256(raw) AS digest, CASE WHEN page_id % 3 = 0 THEN 'DECODE_ERROR' END AS error_code FROM p
""",
    "tidy_ids": """
SELECT p_partkey, replace(lower(replace(p_name, ' ', '_')), '_', '-') AS name, CASE WHEN p_partkey % 4 <> 0 THEN upper(replace(p_name, ' ', '_')) END AS typed, p_partkey % 4 <> 0 AS same FROM part
""",
}

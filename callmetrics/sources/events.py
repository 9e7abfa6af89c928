"""Lifecycle events, envelopes as JSON, declarations and manifests."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import result_key, text_of
from ..schemas import DECLARATIONS, ERROR, STATUSES


def normalised(logs: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Logged events (at, attributes as JSON) with event_name, call_id, function_id, function_version, whether keys are dotted or nested."""
    a = F.col(attributes)
    get = lambda dotted: F.coalesce(F.get_json_object(a, f"$['{dotted}']"), F.get_json_object(a, f"$.{dotted}"))
    return logs.withColumns({"event_name": get("event.name"), "call_id": get("call_id"), "function_id": get("function_id"), "function_version": get("function_version")})


def emitted(outcomes: DataFrame, name: str) -> DataFrame:
    """Events of outcomes: name, time, ids, and all other scalar columns as attributes without nulls."""
    fixed = ("at", "call_id", "function_id", "function_version")
    rest = [c for c, kind in outcomes.dtypes if c not in fixed and kind in ("string", "int", "bigint", "double", "boolean")]
    attrs = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>"), lambda _, v: v.isNotNull())
    return outcomes.select(F.lit(name).alias("event_name"), "at", "call_id", "function_id", "function_version", attrs.alias("attrs"), F.lit("ERROR" if name in ("call.failed", "call.dead_lettered") else "INFO").alias("severity"))


def reference_json(references: DataFrame, hydrator_version: str = "1") -> DataFrame:
    """References as JSON messages: key and partition_key (the call), headers, value. Bytes are base64, times ISO-8601."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.to_json(F.struct("envelope_version", "call_id", "object_key", "sample_rate", "channels", "duration_seconds", iso("ingested_at").alias("ingested_at"), iso("hydrated_at").alias("hydrated_at"), F.base64("source_metadata").alias("source_metadata")))
    headers = F.create_map(F.lit("call_id"), F.col("call_id"), F.lit("hydrator_version"), F.lit(hydrator_version))
    return references.select(F.col("call_id").alias("key"), F.col("call_id").alias("partition_key"), headers.alias("headers"), body.alias("value"))


def reference_of_json(messages: DataFrame) -> DataFrame:
    """References of JSON messages; missing fields take their defaults, unreadable calls get error_code DECODE_ERROR."""
    j = F.from_json("value", "envelope_version INT, call_id STRING, object_key STRING, sample_rate INT, channels INT, duration_seconds DOUBLE, ingested_at STRING, hydrated_at STRING, source_metadata STRING")
    d = messages.select(j.alias("j"))
    default = lambda c, v: F.coalesce(F.col(f"j.{c}"), F.lit(v)).alias(c)
    version = F.coalesce(F.nullif(F.col("j.envelope_version"), F.lit(0)), F.lit(1))
    return d.select(
        version.alias("envelope_version"), "j.call_id", "j.object_key", default("sample_rate", 16000), default("channels", 1), default("duration_seconds", 0.0),
        F.try_to_timestamp("j.ingested_at").alias("ingested_at"), F.try_to_timestamp("j.hydrated_at").alias("hydrated_at"), F.unbase64("j.source_metadata").alias("source_metadata"),
        F.when(F.coalesce(F.col("j.call_id"), F.lit("")) == "", "DECODE_ERROR").alias("error_code"),
    )


def read_references(messages: DataFrame) -> DataFrame:
    """Messages (value as bytes) with the columns of the reference that each holds, and error_code DECODE_ERROR where it holds none."""
    text = messages.withColumn("_text", text_of(F.col("value")))
    j = F.from_json("_text", "envelope_version INT, call_id STRING, object_key STRING, sample_rate INT, channels INT, duration_seconds DOUBLE")
    d = text.withColumn("_j", j)
    fields = {"call_id": F.col("_j.call_id"), "object_key": F.coalesce("_j.object_key", F.concat("_j.call_id", F.lit(".flac"))), "sample_rate": F.coalesce("_j.sample_rate", F.lit(16000)), "duration_seconds": F.coalesce("_j.duration_seconds", F.lit(0.0))}
    return d.select(*messages.columns, *[c.alias(k) for k, c in fields.items()], F.when(F.coalesce("_j.call_id", F.lit("")) == "", "DECODE_ERROR").alias("error_code"))


_RESULT = ("envelope_version", "call_id", "function_id", "function_version", "status", "payload", "payload_ref", "payload_content_type", "payload_schema_version", "input_object_key", "input_offset", "attempt")
_TIMES = ("ingested_at", "started_at", "completed_at")


def result_json(results: DataFrame) -> DataFrame:
    """Results as JSON messages: key (the composite key), partition_key (the call), headers and value. Columns that a result lacks are left out. A payload of bytes is base64, and payload_encoding says so."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c)
    if dict(results.dtypes).get("payload") == "binary":
        results = results.withColumns({"payload": F.base64("payload"), "payload_encoding": F.when(F.col("payload").isNotNull(), "base64")})
    fields = [F.col(c) for c in (*_RESULT, "payload_encoding") if c in results.columns] + [iso(c) for c in _TIMES if c in results.columns] + [F.col("error")] * ("error" in results.columns)
    headers = F.create_map(*[x for c in ("function_id", "function_version", "status") for x in (F.lit(c), F.col(c).cast("string"))])
    return results.select(result_key().alias("key"), F.col("call_id").alias("partition_key"), headers.alias("headers"), F.to_json(F.struct(*fields)).alias("value"))


def result_of_json(messages: DataFrame, payload: str = "text") -> DataFrame:
    """Results of JSON messages. What is not JSON, lacks a key, has no known status, or has both a payload and a reference, gets error_code DECODE_ERROR; an unknown status reads as null.

    The payload is read as `text` or as `bytes`, however it was written; bytes that are no text, or no base64 where the message says so, are
    a DECODE_ERROR without a payload.
    """
    j = F.from_json("value", ", ".join([*(f"{c} {kind}" for c, kind in zip(_RESULT, ["INT", *["STRING"] * 9, "BIGINT", "INT"], strict=True)), *(f"{c} STRING" for c in _TIMES), "payload_encoding STRING", f"error {ERROR}"]))
    d = messages.select(j.alias("j")).select("j.*")
    coded = F.coalesce(F.col("payload_encoding") == "base64", F.lit(False))
    raw = F.when(coded, F.try_to_binary("payload", F.lit("base64"))).otherwise(F.col("payload").cast("binary"))
    value = raw if payload == "bytes" else F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    d = d.withColumns({"payload": value, "_lost": F.col("payload").isNotNull() & value.isNull()}).drop("payload_encoding")
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    named = F.lit(True)
    for c in ("call_id", "function_id", "function_version"):
        named = named & (F.coalesce(F.col(c), F.lit("")) != "")
    good = known & named & ~F.col("_lost") & ~(F.col("payload").isNotNull() & F.col("payload_ref").isNotNull())
    return d.withColumns({"envelope_version": F.coalesce(F.nullif("envelope_version", F.lit(0)), F.lit(1)), "status": F.when(known, F.col("status")), "error_code": F.when(~good, "DECODE_ERROR")} | {c: F.try_to_timestamp(c) for c in _TIMES}).drop("_lost")


def header(name: str, default: str = "", headers: str = "headers") -> Column:
    """A header of a message (a map of bytes) as text, or the default where it is absent."""
    return F.coalesce(text_of(F.col(headers)[name]), F.lit(default))


def call_of_key(key: str = "key") -> Column:
    """The call that a message's key names: empty if there is no key or it is not UTF-8."""
    return F.when(F.is_valid_utf8(F.col(key).cast("string")), F.col(key).cast("string")).otherwise("")


#: Values of a declaration that are not given.
DEFAULTS = {
    "input_topic": "calls.internal", "results_topic": "calls.results", "results_topic_partitions": 200, "in_flight": 1, "per_file_timeout_seconds": 300.0,
    "retry_budget": 3, "retry_backoff_seconds": 2.0, "retry_backoff_max_seconds": 300.0, "payload_schema": None,
}
_POSITIVE = ("results_topic_partitions", "in_flight", "per_file_timeout_seconds", "retry_budget", "retry_backoff_seconds", "retry_backoff_max_seconds")
#: Keys of a declaration that steer a poll loop. They are read and not kept, as Spark has that work.
_UNUSED = ("poll_timeout_seconds", "commit_interval_seconds", "rebalance_drain_seconds")
_RESOURCES = ("cpu", "memory", "gpu")


def _declared(d: dict, names: list[str]) -> tuple | str:
    """A row of a declaration, or why it is rejected."""
    if not isinstance(d, dict):
        return "not a mapping"
    lacking = [k for k in ("function_id", "function_version", "image") if not d.get(k)]
    unknown = sorted(set(map(str, d)) - set(names) - set(_UNUSED))
    resources = d.get("resources") or {}
    row = DEFAULTS | {"dlq_topic": f"calls.dlq.{d.get('function_id')}"} | {k: v for k, v in d.items() if v is not None}
    low = [k for k in _POSITIVE if isinstance(row[k], bool) or not isinstance(row[k], (int, float)) or row[k] <= 0]
    if lacking or unknown or low:
        return f"missing {lacking}" if lacking else f"unknown {unknown}" if unknown else f"not positive {low}"
    if not isinstance(resources, dict) or set(resources) - set(_RESOURCES):
        return f"resources are {list(_RESOURCES)}"
    try:
        cpu, memory, gpu = (resources.get(k) for k in _RESOURCES)
        row |= {"resources": (None if cpu is None else float(cpu), None if memory is None else str(memory), None if gpu is None else int(gpu))}
        return tuple(row[k] if k in ("resources", "payload_schema") else float(row[k]) if "seconds" in k else int(row[k]) if k in _POSITIVE else str(row[k]) for k in names)
    except (TypeError, ValueError) as e:
        return str(e)


def declarations(spark: SparkSession, given: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Declared functions as a table, and those that were rejected with the reason. Declarations are configuration, read on the driver. Of several of a function the last counts."""
    names = [f.name for f in spark.createDataFrame([], DECLARATIONS).schema]
    rows = [(str(d.get("function_id")) if isinstance(d, dict) else "None", _declared(d, names)) for d in given]
    good = {name: row for name, row in rows if not isinstance(row, str)}
    bad = [(name, why) for name, why in rows if isinstance(why, str)]
    return spark.createDataFrame(list(good.values()), DECLARATIONS), spark.createDataFrame(bad, "function_id string, reason string")


def declaration_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Declarations of files, JSON or, where its parser is installed, YAML: `path` may hold wild cards, as in `functions/*/function.yaml`. A file that cannot be read is rejected under its path; without a match there are none."""
    try:
        import yaml

        parse, wrong = yaml.safe_load, (yaml.YAMLError, ValueError)
    except ImportError:
        parse, wrong = json.loads, (ValueError,)
    try:
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").orderBy("path").collect()  # configuration
    except AnalysisException:
        files = []
    given, lost = [], []
    for r in files:
        try:
            given.append(parse(r["value"]) or {})
        except wrong as e:
            lost.append((r["path"], str(e).split("\n")[0]))
    good, bad = declarations(spark, given)
    return good, bad.unionByName(spark.createDataFrame(lost, "function_id string, reason string"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Expected calls of a JSON file with a list `records`."""
    schema = "records ARRAY<STRUCT<call_id: STRING, audio_id: STRING, expect: STRING, filename: STRING, seconds: DOUBLE>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("records"))

"""Schemas of the tables that the operators exchange, as Spark DDL."""

REFERENCES = "envelope_version INT, call_id STRING, object_key STRING, sample_rate INT, channels INT, duration_seconds DOUBLE, ingested_at TIMESTAMP, hydrated_at TIMESTAMP, source_metadata BINARY"
ERROR = "STRUCT<code: STRING, message: STRING, retryable: BOOLEAN>"
RESULTS = (
    f"envelope_version INT, call_id STRING, function_id STRING, function_version STRING, status STRING, error {ERROR}, "
    "payload_schema_version STRING, payload_content_type STRING, payload STRING, payload_ref STRING, input_object_key STRING, input_offset BIGINT, "
    "attempt INT, ingested_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"
)
DEAD_LETTERS = (
    "function_id STRING, function_version STRING, group_id STRING, error_code STRING, error_message STRING, retryable BOOLEAN, attempt INT, "
    "call_id STRING, source_topic STRING, source_partition INT, source_offset BIGINT, failed_at STRING, key BINARY, body BINARY"
)
EVENTS = "event_name STRING, at TIMESTAMP, call_id STRING, function_id STRING, function_version STRING, attrs MAP<STRING, STRING>"
DECLARATIONS = (
    "function_id STRING, function_version STRING, image STRING, input_topic STRING, results_topic STRING, results_topic_partitions INT, dlq_topic STRING, "
    "in_flight INT, per_file_timeout_seconds DOUBLE, retry_budget INT, retry_backoff_seconds DOUBLE, retry_backoff_max_seconds DOUBLE, payload_schema STRING, "
    "resources STRUCT<cpu: DOUBLE, memory: STRING, gpu: INT>"
)
MESSAGES = "topic STRING, partition INT, offset BIGINT, key BINARY, value BINARY, timestamp TIMESTAMP, headers MAP<STRING, BINARY>"
BLOCKS = "call_id STRING, sample_rate INT, start_sample BIGINT, samples ARRAY<FLOAT>, after ARRAY<FLOAT>"

#: Fixed values of the envelope.
STATUSES = ("SUCCESS", "FAILED", "SKIPPED")
CANONICAL = {"sample_rate": 16000, "channels": 1, "bits_per_sample": 16}
CLAIM_CHECK_BYTES = 262_144
HYDRATOR = "hydrator"

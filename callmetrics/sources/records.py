"""Source records and recordings: decoding, header reading and the canonical-audio gate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import object_key, text_of
from ..operators.signals import BLOCK
from ..schemas import CANONICAL
from .wav import SCHEMA, blocks_between


def decoded(messages: DataFrame, *, call: str = "call_id", audio: str = "audio_id", ingested: str = "ingested_at") -> DataFrame:
    """Messages (raw BINARY) with call_id, audio_id, ingested_at and error_code (DECODE_ERROR or null); raw bytes stay as they are.

    A record must be a JSON object with non-empty strings as ids; a time, if present, must be ISO-8601.
    """
    doc = F.try_parse_json(text_of(F.col("raw")))

    def text(path: str) -> Column:
        value = F.try_variant_get(doc, f"$.{path}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(doc, f"$.{path}", "string"), F.lit("")))

    at = F.try_to_timestamp(text(ingested))
    there = F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{ingested}", "variant")) != "VOID", F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    good = is_object & text(call).isNotNull() & text(audio).isNotNull() & (~there | at.isNotNull())
    return messages.withColumns({"call_id": F.when(good, text(call)), "audio_id": F.when(good, text(audio)), "ingested_at": F.when(good, at), "error_code": F.when(~good, "DECODE_ERROR")})


def streaminfo(content: str = "content") -> dict[str, Column]:
    """Columns read from a FLAC header: header_error (null if it is readable), sample_rate, channels, bits_per_sample, total_samples, duration_seconds.

    A total of 0 means that the duration is unknown.
    """
    c = F.col(content)
    size, h = F.coalesce(F.octet_length(c), F.lit(0)), F.hex(F.substring(c, 19, 8))
    number = lambda x: F.conv(x, 16, 10).cast("long")
    kind = number(F.hex(F.substring(c, 5, 1))).bitwiseAND(F.lit(127))
    error = (
        F.when((size < 4) | (F.hex(F.substring(c, 1, 4)) != "664C6143"), "missing magic").when(size < 8, "truncated").when(kind != 0, "first block is not stream info")
        .when(number(F.hex(F.substring(c, 6, 3))) != 34, "wrong length").when(size < 42, "truncated")
    )
    # Rate: 20 bits; channels less one: 3; bits less one: 5; total: 36.
    middle = number(F.substring(h, 6, 2))
    fields = {
        "sample_rate": number(F.substring(h, 1, 5)).cast("int"), "channels": (F.shiftright(middle, 5).bitwiseAND(F.lit(7)) + 1).cast("int"),
        "bits_per_sample": (middle.bitwiseAND(F.lit(31)) + 1).cast("int"), "total_samples": number(F.substring(h, 8, 9)),
    }
    out = {"header_error": error} | {k: F.when(error.isNull(), v) for k, v in fields.items()}
    total, rate = out["total_samples"], out["sample_rate"]
    return out | {"duration_seconds": F.when((total > 0) & (rate > 0), total / rate)}


def canonical_gate(df: DataFrame) -> DataFrame:
    """Rows with the columns of `streaminfo` get error_code: null only for canonical audio."""
    ok = F.lit(True)
    for name, value in CANONICAL.items():
        ok = ok & (F.col(name) == value)
    code = F.when(F.col("header_error").isNotNull(), "AUDIO_NOT_FLAC").when(F.col("total_samples") == 0, "AUDIO_NO_DURATION").when(~ok, "AUDIO_NOT_CANONICAL")
    return df.withColumn("error_code", code)


def fetched(records: DataFrame, recordings: DataFrame) -> DataFrame:
    """Records with `content` of their recording (audio_id, content); without one, error_code AUDIO_NOT_FOUND.

    Recordings may carry `http_status` of a fetch: one that failed with another status than 404 and 410 is AUDIO_API_ERROR,
    which may be tried again.
    """
    status = F.col("http_status") if "http_status" in recordings.columns else F.lit(None).cast("int")
    df = records.join(recordings.select("audio_id", "content", status.alias("_status")), "audio_id", "left")
    lost = F.when(F.coalesce(~F.col("_status").isin(200, 404, 410), F.lit(False)), "AUDIO_API_ERROR").otherwise("AUDIO_NOT_FOUND")
    return df.withColumn("error_code", F.coalesce(F.col("error_code"), F.when(F.col("content").isNull(), lost))).drop("_status")


def with_fallback(references: DataFrame, live: DataFrame, archive: DataFrame) -> DataFrame:
    """References with `content` by object_key, from the archive where the object has expired; OBJECT_MISSING where neither has it."""
    df = references.join(live.select("object_key", F.col("content").alias("_live")), "object_key", "left").join(archive.select("object_key", F.col("content").alias("_old")), "object_key", "left")
    content = F.coalesce("_live", "_old")
    return df.withColumns({"content": content, "error_code": F.when(content.isNull(), "OBJECT_MISSING")}).drop("_live", "_old")


def hydrated(good: DataFrame, now: Column | None = None) -> DataFrame:
    """References of canonical recordings."""
    return good.select(
        F.lit(1).alias("envelope_version"), "call_id", object_key().alias("object_key"), "sample_rate", "channels", "duration_seconds", "ingested_at",
        (F.current_timestamp() if now is None else now).alias("hydrated_at"), F.col("raw").alias("source_metadata"),
    )


def wav_blocks(recordings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of WAV recordings that are given as bytes: call_id, content, sample_rate (claimed; null claims nothing) in; call_id, sample_rate, start_sample, samples, after, error_code out.

    Bad bytes, another rate and more than one channel each give one row with an error and no samples. Recordings that
    are files are better read by ranges (`wav.wav_files`).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for call, raw, claimed in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = raw.as_buffer() if raw.is_valid else pa.py_buffer(b"")
                yield from blocks_between(call.as_py(), lambda at, n, raw=raw: raw[at : at + n].to_pybytes(), raw.size, 0, max(1, raw.size), block, claimed.as_py())

    return recordings.select("call_id", "content", F.col("sample_rate").cast("int")).mapInArrow(decode, SCHEMA)

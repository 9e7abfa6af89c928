"""Column functions: decibels, stable buckets, backoff, safe parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amplitude_db(rms: Column, floor: float = -120.0) -> Column:
    """20 log10 of an amplitude; the floor for silence."""
    return F.when(rms > 0, 20.0 * F.log10(rms)).otherwise(F.lit(floor))


def power_db(power: Column, floor: float) -> Column:
    """10 log10 of a power; the floor where it is not positive."""
    return F.when(power > 0, 10.0 * F.log10(power)).otherwise(F.lit(floor))


def amplitude_of(db: float) -> float:
    return 10.0 ** (db / 20.0)


def hash_bucket(key: Column) -> Column:
    """A stable number in [0, 1): the first 8 bytes of the key's SHA-256 over 2**64."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def backoff_seconds(attempt: Column, base: Column, cap: Column) -> Column:
    """Exponential backoff before the next attempt, at most the cap."""
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), cap)


def required_concurrency(speedup: Column, hours_per_hour: float = 5000.0) -> Column:
    """Files in flight that keep up with so many audio hours an hour."""
    return F.ceil(F.lit(hours_per_hour) / speedup)


def result_key(call: str = "call_id", function: str = "function_id", version: str = "function_version") -> Column:
    return F.concat_ws(":", call, function, version)


def object_key(call: str = "call_id") -> Column:
    return F.concat(F.col(call), F.lit(".flac"))


def seconds_between(start: str, end: str) -> Column:
    """Null where either side is null."""
    return F.col(end).cast("timestamp").cast("double") - F.col(start).cast("timestamp").cast("double")


def text_of(raw: Column) -> Column:
    """Bytes as text, bad UTF-8 replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def truncated_bytes(text: Column, size: int = 1024) -> Column:
    """Text cut to a number of UTF-8 bytes; a character cut in two is replaced."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string"))


def int_or(text: Column, default: int = -1) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def split_group(group: Column) -> tuple[Column, Column]:
    """(id, version) of `id:version`, split at the first colon."""
    return F.split(group, ":", 2)[0], F.split(group, ":", 2)[1]


def hann(size: int) -> Column:
    """The symmetric Hann window as an array of doubles."""
    step = F.lit(2.0) * F.pi() / F.lit(float(size - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda n: 0.5 - 0.5 * F.cos(step * n))


def explode_payload(df: DataFrame, payload: str = "payload", most: int = 12) -> DataFrame:
    """One row for each of the payload's first `most` scalar fields, in order of name: field, value, and `fraction` for numbers from 0 to 1.

    Booleans read yes or no. Payloads that are not JSON objects give no rows.
    """
    fields = F.from_json(payload, "map<string,string>")
    scalar = F.map_filter(fields, lambda k, v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))
    first = F.slice(F.array_sort(F.map_keys(scalar)), 1, most)
    out = df.withColumn("_fields", scalar).withColumn("field", F.explode(first)).withColumn("_value", F.element_at("_fields", F.col("field")))
    number = F.col("_value").try_cast("double")
    value = F.when(F.col("_value") == "true", "yes").when(F.col("_value") == "false", "no").otherwise(F.col("_value"))
    return out.withColumns({"value": value, "fraction": F.when(number.between(0.0, 1.0), number)}).drop("_fields", "_value")


def dashed(name: Column) -> Column:
    """A function's id as the name of what runs it: underscores become dashes."""
    return F.replace(name, F.lit("_"), F.lit("-"))


def tidy(text: Column) -> Column:
    """An id as a user typed it, without white space around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def same_id(a: Column, b: Column) -> Column:
    """Whether two typed ids name the same, case and white space around them aside."""
    return F.coalesce(F.lower(tidy(a)) == F.lower(tidy(b)), F.lit(False))

"""Quantiles of streams and of history by mergeable sketches.

A sketch (KLL) of a window and function is a few kilobytes, whatever it has seen. Sketches of windows merge to that of a
day or of all functions; on a stream they are the state of a windowed aggregate. The rank of an estimate is off by at most
`rank_error(k)` of all values, with a probability of 99 %. Nulls, NaN and infinities are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seconds_between

#: Accuracy: a rank is off by 0.13 %.
K = 4096


def rank_error(k: int = K) -> float:
    """Largest share of all values by which an estimate's rank is off, with 99 % probability: the published fit for KLL."""
    return 2.296 / k**0.9021


def _seen(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sketched(df: DataFrame, key: list[str], value: str, *, every: str | None = None, at: str = "completed_at", k: int = K) -> DataFrame:
    """A sketch of each key, and of each window of time if `every` is given (window_start): `sketch`, and `n` values in it. Works on streams that have a watermark on `at`."""
    by = [*key, *([F.window(at, every).alias("w")] if every else [])]
    v = _seen(F.col(value))
    out = df.withColumn("_v", v).filter("_v IS NOT NULL").groupBy(*by).agg(F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count("*").alias("n"))
    return out.select(*([F.col("w.start").alias("window_start")] if every else []), *key, "sketch", "n")


def merged(sketches: DataFrame, key: list[str]) -> DataFrame:
    """Sketches of coarser keys, or of all windows."""
    return sketches.groupBy(*key).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def estimates(sketches: DataFrame, shares: dict[str, float], sketch: str = "sketch") -> DataFrame:
    """The sketches' rows with a column for each share: its quantile."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for name, q in shares.items()})


LATENCY = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
MULTIPLE = {"p05": 0.05, "p50": 0.5}


def windowed_latency(results: DataFrame, every: str = "5 minutes", late: str = "10 minutes", *, k: int = K) -> DataFrame:
    """p50, p95 and p99 of seconds from ingest to completion, by window, function and version. On a stream, a window is given when no more of it is awaited."""
    df = results.withWatermark("completed_at", late) if results.isStreaming else results
    seconds = df.withColumn("_seconds", seconds_between("ingested_at", "completed_at"))
    return estimates(sketched(seconds, ["function_id", "function_version"], "_seconds", every=every, k=k), LATENCY).drop("sketch")


def windowed_multiples(results: DataFrame, every: str = "5 minutes", late: str = "10 minutes", *, k: int = K) -> DataFrame:
    """p05 and p50 of the realtime multiple (column `multiple`), by window, function and version."""
    df = results.withWatermark("completed_at", late) if results.isStreaming else results
    return estimates(sketched(df, ["function_id", "function_version"], "multiple", every=every, k=k), MULTIPLE).drop("sketch")

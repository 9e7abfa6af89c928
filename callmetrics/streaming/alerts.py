"""Alerts on streams of samples: a condition that has held for the last samples of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class _Sustained(StatefulProcessor):
    """Per key how many samples in a row have met the condition, and the time of the last one."""

    def __init__(self, sustained: int):
        self.sustained = sustained

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n int, at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = sorted((int(at), bool(flag)) for pdf in rows for at, flag in zip(pdf["at_us"], pdf["flag"], strict=True))
        n, last = self.run.get() if self.run.exists() else (0, -(1 << 62))
        out = []
        for at, flag in samples:
            if at > last:  # a sample that comes after a later one is not judged
                n, last = (n + 1 if flag else 0), at
                out.append((key[0], at, n >= self.sustained))
        self.run.update((n, last))
        yield pd.DataFrame(out, columns=["key", "at_us", "alert"])

    def close(self) -> None:
        pass


def sustained_alerts(samples: DataFrame, key: str, flag: Column, sustained: int) -> DataFrame:
    """Each sample of a stream (key, at) with `alert`: whether the flag has held in each of the key's last `sustained` samples. As `fleet` judges a table of samples, in the order of `at`; state is two numbers a key.

    Samples without a time are not seen, a null flag is false. Needs the RocksDB state store.
    """
    rows = samples.filter("at IS NOT NULL").select(F.col(key).cast("string").alias("key"), F.unix_micros("at").alias("at_us"), F.coalesce(flag, F.lit(False)).alias("flag"))
    found = rows.groupBy("key").transformWithStateInPandas(_Sustained(sustained), "key string, at_us long, alert boolean", "append", "none")
    return found.select(F.col("key").alias(key), F.timestamp_micros("at_us").alias("at"), "alert")


def dead_letter_alerts(samples: DataFrame, most: float = 0.1, sustained: int = 10) -> DataFrame:
    """`fleet.dead_letter_alerts` on a stream of samples (function_id, at, rate)."""
    return sustained_alerts(samples, "function_id", F.col("rate") > most, sustained)


def slow_alerts(samples: DataFrame, floor: float = 25.0, sustained: int = 30) -> DataFrame:
    """`fleet.slow_alerts` on a stream of samples (function_id, at, multiple)."""
    return sustained_alerts(samples, "function_id", F.col("multiple") < floor, sustained)


def backlog_alerts(samples: DataFrame, seconds: float = 3600.0, sustained: int = 10) -> DataFrame:
    """Groups that are more than some seconds behind, on a stream of samples (group_id, at, lag, rate): with nothing taken and something left the lag is endless and counts, with nothing left it is none."""
    late = F.when(F.col("rate") > 0, F.col("lag") / F.col("rate") > seconds).otherwise(F.col("lag") > 0)
    return sustained_alerts(samples, "group_id", late, sustained)

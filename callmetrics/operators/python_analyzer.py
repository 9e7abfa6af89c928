"""Analyzers written in Python: one function of (reference, samples) for each recording."""

from __future__ import annotations

import inspect
import json
import traceback
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class AnalyzerError(Exception):
    """An error with a code; `retryable` says whether running again may help."""

    def __init__(self, code: str, message: str = "", retryable: bool = False):
        super().__init__(message)
        self.code, self.retryable = code, retryable


Process = Callable[[dict, np.ndarray], dict | None]
OUTCOME = "call_id string, status string, payload string, error struct<code:string,message:string,retryable:boolean>, process_seconds double"


def validate(function_id: str, version: str, factory: Callable[[], Process]) -> None:
    """A registered analyzer has an id, a version, and a factory that makes the function in the worker."""
    if not function_id or not version or ":" in function_id:
        raise ValueError("an analyzer needs an id without colon and a version")
    if not callable(factory) or inspect.signature(factory).parameters:
        raise TypeError("give a factory without arguments, not an instance")


def outcome(process: Process, reference: dict, samples: np.ndarray) -> tuple[str, str | None, tuple | None]:
    """Status, payload as JSON, and error; never raises. None means SKIPPED."""
    try:
        got = process(reference, samples)
    except AnalyzerError as e:
        return "FAILED", None, (e.code, str(e), e.retryable)
    except Exception as e:  # an author's code may raise anything
        return "FAILED", None, ("UNHANDLED", f"{type(e).__name__}: {e}\n{traceback.format_exc()}", True)
    if got is None:
        return "SKIPPED", None, None
    if not isinstance(got, dict):
        return "FAILED", None, ("BAD_RETURN", f"returned {type(got).__name__}", False)
    return "SUCCESS", json.dumps(got, sort_keys=True), None


def from_python(factory: Callable[[], Process]) -> Callable[[DataFrame], DataFrame]:
    """An operator on recordings (call_id, sample_rate, samples) that runs the function once for each row and never fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        process = factory()  # once for each task
        for pdf in batches:
            rows = []
            for call, rate, samples in zip(pdf["call_id"], pdf["sample_rate"], pdf["samples"], strict=True):
                began = time.perf_counter()
                status, payload, error = outcome(process, {"call_id": call, "sample_rate": rate}, np.asarray(samples, np.float32))
                rows.append((call, status, payload, error and dict(zip(("code", "message", "retryable"), error, strict=True)), time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["call_id", "status", "payload", "error", "process_seconds"])

    return lambda recordings: recordings.select(F.col("call_id").cast("string"), "sample_rate", "samples").mapInPandas(run, OUTCOME)


def ad_hoc(analyze: Callable[[DataFrame], DataFrame], recordings: DataFrame, audio_id: str) -> DataFrame:
    """An analyzer of Python on one recording (audio_id, call_id, sample_rate, samples): its outcome, the audio's seconds and the realtime multiple."""
    one = recordings.filter(F.col("audio_id") == audio_id)
    audio = one.select(F.col("call_id").cast("string").alias("call_id"), (F.size("samples") / F.col("sample_rate")).alias("audio_seconds"))
    took = F.nullif(F.col("process_seconds"), F.lit(0.0))
    return analyze(one).join(audio, "call_id").withColumn("multiple", F.col("audio_seconds") / took)

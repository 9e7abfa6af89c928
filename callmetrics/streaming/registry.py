"""One stream for each declared function; functions that read another's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from . import analysis

#: What a function downstream reads of a result.
RESULT = "call_id string, function_id string, function_version string, status string, input_object_key string, payload string, payload_ref string, depth int"
Analyze = Callable[[DataFrame], DataFrame]


def checked_depths(declared: DataFrame, most: int = 5) -> dict[str, int]:
    """Depth of each function of a registry (function_id, upstream: null for those that read references), 1 for these. A cycle, an upstream that nobody declares, or more than `most` levels is an error.

    A registry is configuration, a row a function, and read on the driver; `chain_depth` does the same for a table of edges.
    """
    upstream = {r["function_id"]: r["upstream"] for r in declared.select("function_id", "upstream").collect()}
    unknown = sorted({u for u in upstream.values() if u is not None} - set(upstream))
    if unknown:
        raise ValueError(f"no function is declared as {unknown}")
    depth: dict[str, int] = {}
    for level in range(1, most + 1):
        depth |= {f: level for f, u in upstream.items() if f not in depth and (u is None or depth.get(u) == level - 1)}
    wrong = sorted(set(upstream) - set(depth))
    if wrong:
        raise ValueError(f"functions on or behind a cycle, or too deep: {wrong}")
    return depth


def _stream_of(spark: SparkSession, path: str, schema: str, per_batch: int) -> DataFrame:
    """Files below a folder, which is made if it is not there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).parquet(path)


def registry_streams(declared: DataFrame, analyzers: dict[str, Analyze], references: Callable[[], DataFrame], out: str, checkpoint: str, *, most: int = 5, files_per_batch: int = 1000) -> dict[str, DataStreamWriter]:
    """A stream for each row of the registry (function_id, function_version, upstream), by function, in the order in which results flow.

    A function without upstream reads `references()`, a new stream each; others read the SUCCESS results of their upstream, with its payload as
    `payload`. `depth` counts the functions that a row has passed, its own included; a row at `most` goes no further. Every stream has its
    own checkpoint, so a function can be added, replayed or stopped alone.
    """
    spark, depth = declared.sparkSession, checked_depths(declared, most)
    rows = {r["function_id"]: r for r in declared.collect()}
    lacking = sorted(set(rows) - set(analyzers))
    if lacking:
        raise ValueError(f"no analyzer for {lacking}")
    out = out.rstrip("/")
    streams = {}
    for name in sorted(rows, key=lambda n: (depth[n], n)):
        row = rows[name]
        if row["upstream"] is None:
            given = references().withColumn("depth", F.lit(1))
        else:
            above = rows[row["upstream"]]
            done = _stream_of(spark, f"{out}/results/of={above['function_id']}-{above['function_version']}", RESULT, files_per_batch)
            given = done.filter(F.col("status") == "SUCCESS").withColumn("depth", F.col("depth") + 1).filter(F.col("depth") <= most)
            given = given.withColumnsRenamed({"function_id": "upstream_id", "function_version": "upstream_version"}).drop("status")
        found = analyzers[name](given)
        kept = [f.name for f in found.schema if not isinstance(f.dataType, T.NullType)]
        streams[name] = analysis(found.select(*kept), out, checkpoint, name, row["function_version"])
    return streams

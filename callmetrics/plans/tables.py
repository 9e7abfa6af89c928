"""Queries on keyed tables and sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seconds_between
from ..operators import fleet as T
from ..operators import sketches as K
from ..operators.delivery import KEY
from ..shared import kept, shared_folder
from ..streaming.keyed import KeyedTable
from . import adapters as D

_SCHEMA = "call_id string, function_id string, function_version string, status string, attempt int, completed_at timestamp, l_partkey bigint, l_suppkey bigint, l_extendedprice double"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]
_CALLS = ["1", "2", "3", "7", "33"]


def _kept(spark: SparkSession, sf_dir: str) -> KeyedTable:
    """All results in a keyed table: two batches that were compacted, and a third on top, in which the second comes once more."""
    rows = D.results(spark, sf_dir).select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in _SCHEMA.split(", "))])
    part = lambda *ks: rows.filter(F.pmod("l_partkey", F.lit(3)).isin(*ks))
    table = KeyedTable(spark, shared_folder(spark, "keyed"), _SCHEMA, KEY, D.ORDER, buckets=16)
    table.append(part(0), 0)
    table.append(part(1), 1)
    table.compact()
    table.append(part(1), 1)  # a batch that is run again
    table.append(part(1, 2), 2)
    return table


def keyed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of each key, through deltas and a compaction."""
    return _kept(spark, sf_dir).read().select(*KEY, "status", "attempt", "completed_at")


def erased_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left by function when the calls of every eleventh order are erased from the table's files."""
    table = _kept(spark, sf_dir)
    orders = D.table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0")
    table.compact(orders.select(F.col("o_orderkey").cast("string").alias("call_id")))
    table.vacuum(keep=1)
    return table.read().groupBy("function_id").agg(F.count("*").alias("results"), F.countDistinct("call_id").alias("calls"))


def looked_up_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a few calls: the files of their buckets are opened, no others."""
    return _kept(spark, sf_dir).lookup(_CALLS).select(*KEY, "status", "attempt")


def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of a quarter and function, merged to those of a function: how many quarters and values, and whether each quantile's rank is within the bound of the exact one."""
    took = T.multiples(D.results(spark, sf_dir), D.references(spark, sf_dir)).withColumn("seconds", seconds_between("started_at", "completed_at"))
    took = kept(took.select("function_id", "completed_at", "seconds", "multiple"), "took")  # joined once, read by sketches and by their check
    out = None
    for value, shares in (("seconds", K.LATENCY), ("multiple", K.MULTIPLE)):
        parts = K.sketched(took, ["function_id"], value, every="90 days", k=1024)
        quarters = parts.groupBy("function_id").agg(F.count("*").alias("windows"))
        whole = K.estimates(K.merged(parts, ["function_id"]), {f"_{n}": q for n, q in shares.items()}).drop("sketch").join(quarters, "function_id")
        error, near = K.rank_error(1024), []
        for n, q in shares.items():
            below, upto = F.count_if(F.col(value) < F.col(f"_{n}")) / F.col("n"), F.count_if(F.col(value) <= F.col(f"_{n}")) / F.col("n")
            near.append(((below <= q + error) & (upto >= q - error)).alias(f"{n}_within"))
        seen = took.select("function_id", value).filter(F.col(value).isNotNull()).join(F.broadcast(whole), "function_id")  # a row a function
        rows = seen.groupBy("function_id", "windows", "n").agg(F.array(*near).alias("w"))
        rows = rows.select("function_id", F.lit(value).alias("measure"), "windows", "n", F.forall("w", lambda x: x).alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out


_LAST = "WITH" + D.RESULTS + """, last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id, function_id, function_version ORDER BY completed_at DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM res) WHERE k = 1
)"""
_SKETCH = """
SELECT function_id, '{name}' AS measure, count(DISTINCT CAST(floor(epoch(completed_at) / 7776000) AS BIGINT)) AS windows, count(*) AS n, true AS within FROM m WHERE {name} IS NOT NULL GROUP BY function_id
"""
QUERIES = {"keyed_results": keyed_results, "erased_table": erased_table, "looked_up_calls": looked_up_calls, "quantile_sketches": quantile_sketches}
SQL = {
    "keyed_results": _LAST + "SELECT call_id, function_id, function_version, status, attempt, completed_at FROM last",
    "erased_table": _LAST + "SELECT function_id, count(*) AS results, count(DISTINCT call_id) AS calls FROM last WHERE CAST(call_id AS BIGINT) % 11 <> 0 GROUP BY function_id",
    "looked_up_calls": _LAST + f"SELECT call_id, function_id, function_version, status, attempt FROM last WHERE call_id IN ({', '.join(repr(c) for c in _CALLS)})",
    "quantile_sketches": "WITH" + D.RESULTS + "," + D.REFERENCES + """, m AS (
  SELECT function_id, completed_at, CAST(l_quantity AS DOUBLE) AS seconds, CASE WHEN duration_seconds > 0 AND l_quantity > 0 THEN duration_seconds / l_quantity END AS multiple FROM res JOIN refs ON res.call_id = refs.call_id
)""" + _SKETCH.format(name="seconds") + "UNION ALL" + _SKETCH.format(name="multiple"),
}

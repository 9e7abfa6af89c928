"""Exact ranks without sorting a whole key, and sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callmetrics import streaming as S
from callmetrics.operators import fleet as T
from callmetrics.operators import sketches as K
from callmetrics.plans import catalog

from .conftest import SMALL

PERCENTS = [0, 10, 50, 95, 99, 100]


def nearest(values, p):
    values = sorted(v for v in values if v is not None and v == v)
    return round(values[min(len(values) - 1, round(p / 100 * (len(values) - 1)))], 4) if values else None


def keys():
    rng = random.Random(1)
    return {
        "outlier": [rng.random() for _ in range(3000)] + [1e9], "tie": [5.0] * 2500 + [float(i) for i in range(600)], "scales": [10.0 ** rng.uniform(-300, 300) for _ in range(2500)],
        "one": [7.0] * 1500, "few": [3.0, 1.0, 2.0, 2.0], "signed": [rng.gauss(0, 1) for _ in range(1200)] + [-0.0, 0.0, float("nan"), None, float("inf"), float("-inf")], None: [float(i % 97) for i in range(1100)], "nothing": [None],
    }


@pytest.mark.parametrize("bound", [None, 100])
def test_ranks(spark, bound):
    rows = [(k, v) for k, values in keys().items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: [r[f"p{p}"] for p in PERCENTS] for r in T.nearest_ranks(df, ["k"], "v", PERCENTS, bound=bound).collect()}
    want = {k: [nearest(v, p) for p in PERCENTS] for k, v in keys().items() if any(x is not None for x in v)}
    for k, values in want.items():
        assert got[k] == pytest.approx(values, rel=1e-12), k
    assert set(got) == set(want)


def test_no_range_is_sorted_that_is_too_large(spark):
    rows = [(k, v) for k, values in keys().items() for v in values]
    numbers = T._numbers(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    wanted = F.array(*[F.struct(F.lit(str(q)).alias("name"), F.floor(F.lit(q) * (F.col("_n") - 1)).alias("at")) for q in (0.1, 0.5, 0.95)])
    ranges = T.ranges_at(numbers, ["k"], wanted, 100)
    assert ranges.filter("_n > 100 AND _low < _high").count() == 0
    asked = ranges.select("k", F.explode("_w.name").alias("name")).groupBy("k").count().collect()
    assert len(asked) == 7 and all(r["count"] == 3 for r in asked)


@pytest.mark.parametrize("bound", [None, 100])
def test_values_are_made_once(spark, bound):
    """Whatever makes the values, a join of two large tables, say, does not run again for each step."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).mapInArrow(counted, "k long, v double")
    got = sorted(tuple(r) for r in T.quantiles(df, ["k"], "v", [0.5], bound=bound).collect())
    assert got == [(0, 999.0), (1, 1000.0), (2, 999.5)] and made.value == 2000


def test_multiples_have_one_plan_at_all_sizes(spark):
    """A broadcast of small sides would make what is shuffled jump when they grow."""
    call, at = F.col("id").cast("string").alias("call_id"), lambda s: F.timestamp_seconds(F.lit(s))
    results = spark.range(1).select(call, at(0).alias("started_at"), at(2).alias("completed_at"))
    out = T.multiples(results, spark.range(1).select(call, F.lit(50.0).alias("duration_seconds")))
    assert out.first()["multiple"] == 25.0
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_sketches_read_the_joined_rows(spark):
    plan = catalog.QUERIES["quantile_sketches"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "l_orderkey" not in plan


def test_sketches_within_their_bound(spark):
    """Rank errors, also of sketches merged over windows, and as the state of a stream."""
    rng = random.Random(2)
    start = datetime(2026, 1, 1)
    rows = [(f"f{i % 2}", "1", start, start + timedelta(seconds=rng.expovariate(0.01), minutes=0), start + timedelta(minutes=i % 50)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "function_id string, function_version string, a timestamp, b timestamp, completed_at timestamp")
    df = df.withColumn("seconds", F.col("b").cast("double") - F.col("a").cast("double"))
    k, shares = 256, {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    parts = K.sketched(df, ["function_id"], "seconds", every="5 minutes", k=k)
    assert parts.count() == 20
    for found in (K.sketched(df, ["function_id"], "seconds", k=k), K.merged(parts, ["function_id"])):
        for r in K.estimates(found, shares).collect():
            values = [x["seconds"] for x in df.filter(F.col("function_id") == r["function_id"]).select("seconds").collect()]
            assert r["n"] == len(values) == 10_000
            for name, q in shares.items():
                below = sum(v < r[name] for v in values) / len(values)
                assert abs(below - q) <= K.rank_error(k) + 1e-4


def test_odd_values_are_not_seen(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, None, float("nan"), float("inf"), float("-inf"))] + [("b", None)], "k string, v double")
    assert [(r["k"], r["n"], r["p50"]) for r in K.estimates(K.sketched(df, ["k"], "v"), {"p50": 0.5}).collect()] == [("a", 1, 1.0)]


def test_windowed_latency_of_a_stream(spark, tmp_path):
    start = datetime(2026, 1, 1)
    schema = "function_id string, function_version string, ingested_at timestamp, completed_at timestamp"
    rows = [("f", "1", start + timedelta(seconds=i), start + timedelta(seconds=i + (i % 100))) for i in range(280)]
    for i, part in enumerate((rows[:100], rows[100:], [("f", "1", start, start + timedelta(days=1))])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    S.run_available(K.windowed_latency(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    got = {r["window_start"]: (r["n"], r["p50"], r["p99"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for _, _, a, b in rows:
        want.setdefault(start + timedelta(seconds=(b - start).total_seconds() // 300 * 300), []).append((b - a).total_seconds())
    assert set(got) == set(want)
    for w, values in want.items():
        assert got[w][0] == len(values) and abs(sum(v <= got[w][1] for v in values) / len(values) - 0.5) < 0.02

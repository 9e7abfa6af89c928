"""Recordings from one row a sample, numbered over several buckets."""

from callmetrics.operators.signals import from_rows


def test_blocks_of_a_long_recording_over_buckets(spark, table):
    rows = [(call, 16, i // 3, i, float(i)) for call, n in (("long", 1000), ("short", 10), (None, 30)) for i in range(n)]
    df = table(rows, "call_id string, sample_rate int, ts long, event_id long, value float").repartition(5)
    for bucket_rows in (50, 1 << 20):
        got = from_rows(df, ["ts", "event_id"], 64, bucket_rows=bucket_rows).collect()
        for call, n in (("long", 1000), ("short", 10), (None, 30)):
            blocks = {r["start_sample"]: r["samples"] for r in got if r["call_id"] == call}
            assert blocks == {s: [float(i) for i in range(s, min(s + 64, n))] for s in range(0, n, 64)}


def test_no_array_of_a_whole_recording_is_built(spark, table):
    df = table([("a", 16, i, float(i)) for i in range(100)], "call_id string, sample_rate int, ts long, value float")
    plan = from_rows(df, ["ts"], 8, bucket_rows=16)._jdf.queryExecution().analyzed().toString()
    gathers = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathers and all(" div " in line for line in gathers)

"""Alerts on streams equal those on tables."""

import random
from datetime import datetime, timedelta

from callmetrics import streaming as S
from callmetrics.operators import fleet as T
from callmetrics.streaming import alerts as A

NOW = datetime(2026, 1, 1)
SCHEMA = "function_id string, at timestamp, rate double, multiple double"


def streamed(spark, tmp_path, rows, alert, cut=3):
    for i in range(cut):
        part = [r for k, r in enumerate(rows) if k * cut // len(rows) == i]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    S.run_available(alert(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"))
    return sorted((r["function_id"], r["at"], r["alert"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_alerts_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"f{k}", NOW + timedelta(minutes=i), rng.choice([0.05, 0.2, 0.3, None]) if k else 0.5, rng.choice([10.0, 20.0, 30.0])) for i in range(30) for k in range(3)]
    table = spark.createDataFrame(rows, SCHEMA)
    for name, live, batch in (("dlq", A.dead_letter_alerts, T.dead_letter_alerts), ("slow", A.slow_alerts, T.slow_alerts)):
        limit = 0.1 if name == "dlq" else 25.0
        got = streamed(spark, tmp_path / name, rows, lambda s, live=live, limit=limit: live(s, limit, 4))
        assert got == sorted((r["function_id"], r["at"], r["alert"]) for r in batch(table, limit, 4).collect()) and any(a for *_, a in got)


def test_late_and_odd_samples(spark, tmp_path):
    rows = [("f", NOW + timedelta(minutes=i), 1.0, None) for i in (0, 1, 2)] + [("f", NOW + timedelta(minutes=1, seconds=30), 0.0, None), ("f", None, 1.0, None), ("f", NOW + timedelta(minutes=3), None, None)]
    got = streamed(spark, tmp_path, rows, lambda s: A.dead_letter_alerts(s, 0.1, 3), cut=2)
    assert [(m.minute, a) for _, m, a in got] == [(0, False), (1, False), (2, True), (3, False)]

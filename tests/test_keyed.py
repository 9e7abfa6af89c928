"""Keyed tables: deltas, compaction, crashes, erasure, look-ups."""

import json

import pytest
from pyspark.sql import functions as F

from callmetrics.streaming.keyed import CommitConflict, KeyedTable, _last

SCHEMA = "call_id string, function_id string, n int, at timestamp"


def table(spark, tmp_path, **more):
    return KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["call_id", "function_id"], ["n"], **({"buckets": 8} | more))


def rows(spark, *values):
    return spark.createDataFrame([(*v, None) for v in values], SCHEMA)


def contents(df):
    return sorted(((r["call_id"], r["function_id"], r["n"]) for r in df.collect()), key=repr)


def files(df):
    """Files that a read opens, from its scans' metrics; they count a frame's first run."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        if p.metrics().contains("numFiles"):
            found += p.metrics().apply("numFiles").value()
    return found


def test_the_last_of_each_key(spark, tmp_path):
    t = table(spark, tmp_path)
    assert contents(t.read()) == []
    assert t.append(rows(spark, ("a", "f", 1), ("a", "f", 3), ("b", "f", 1), (None, "f", 1)), 0)
    assert t.append(rows(spark, ("a", "f", 2), ("b", "f", 1), ("c", None, 1), (None, "f", 2)), 1)
    want = [("a", "f", 3), ("b", "f", 1), ("c", None, 1), (None, "f", 2)]
    assert contents(t.read()) == want
    t.compact()
    assert contents(t.read()) == want and t.manifest().deltas == {}
    t.append(rows(spark, ("c", None, 5), ("b", "f", 0)), 2)
    assert contents(t.read()) == [("a", "f", 3), ("b", "f", 1), ("c", None, 5), (None, "f", 2)]


def test_a_batch_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", "f", 1)), 7)
    assert not t.append(rows(spark, ("a", "f", 9)), 7)
    t.compact()
    assert not t.append(rows(spark, ("a", "f", 9)), 7) and contents(t.read()) == [("a", "f", 1)]


def test_a_read_costs_what_is_there_not_the_batches(spark, tmp_path):
    t = table(spark, tmp_path)
    for i in range(6):
        t.append(rows(spark, *[(f"c{j}", "f", i) for j in range(20)]), i)
    before = files(t.read())
    t.compact()
    assert files(t.read()) <= 8 < before and len(contents(t.read())) == 20


def test_compaction_touches_few_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, *[(f"c{j}", "f", 1) for j in range(40)]), 0)
    first = t.compact().base
    t.append(rows(spark, ("c3", "f", 2)), 1)
    second = t.compact().base
    assert sum(first[b] != second[b] for b in first) == 1 and ("c3", "f", 2) in contents(t.read())


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", "f", 1), ("b", "f", 1)), 0)
    before = contents(t.read())

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lost)
        for job in (lambda: t.compact(), lambda: t.append(rows(spark, ("a", "f", 5)), 1)):
            with pytest.raises(RuntimeError):
                job()
    assert contents(t.read()) == before and t.versions() == [1]
    assert t.append(rows(spark, ("a", "f", 5)), 1)  # the stream runs the batch again
    t.compact()
    assert contents(t.read()) == [("a", "f", 5), ("b", "f", 1)]
    assert t.vacuum(keep=1) >= 3 and contents(t.read()) == [("a", "f", 5), ("b", "f", 1)]


def test_two_writers(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", "f", 1)), 0)
    seen = t.manifest()
    t.append(rows(spark, ("b", "f", 1)), 1)
    with pytest.raises(CommitConflict):
        t._commit(seen, seen.base, seen.deltas)
    assert contents(t.read()) == [("a", "f", 1), ("b", "f", 1)]
    assert json.loads((tmp_path / "t" / "manifests" / f"{2:020d}.json").read_text())["version"] == 2


def test_erasure(spark, tmp_path):
    """A bucket that is erased as a whole is gone; who reads the old version finishes; other buckets' files stay."""
    t = table(spark, tmp_path)
    t.append(rows(spark, *[(f"c{j}", f, 1) for j in range(12) for f in ("f", "g")]), 0)
    old = t.compact()
    where = {r["call_id"]: r["b"] for r in t.read().select("call_id", t.bucket().alias("b")).collect()}
    bucket = where["c5"]
    names = [c for c, b in where.items() if b == bucket]
    t.append(rows(spark, ("c5", "f", 9)), 1)
    reader = t.read(version=old.version)
    new = t.compact(spark.createDataFrame([(c,) for c in [*names, "unknown", None]], "call_id string"))
    assert bucket not in new.base and all(new.base[b] == old.base[b] for b in old.base if b != bucket)
    assert {r[0] for r in contents(t.read())} == set(where) - set(names)
    assert len(contents(reader)) == 24
    t.vacuum(keep=1)
    held = spark.read.parquet(*[f"file://{p}" for p in (tmp_path / "t").glob("base-*/_bucket=*")]).filter(F.col("call_id").isin(*names))
    assert held.count() == 0 and not list((tmp_path / "t").glob(f"base-*/_bucket={bucket}"))


def test_everything_erased(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", "f", 1)), 0)
    t.compact(spark.createDataFrame([("a",)], "call_id string"))
    assert contents(t.read()) == [] and t.manifest().base == {}


def test_lookups_open_one_bucket(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.append(rows(spark, *[(f"c{j}", "f", 1) for j in range(200)]), 0)
    t.compact()
    assert contents(t.lookup(["c7"])) == [("c7", "f", 1)] and files(t.lookup(["c7"])) == 1 and files(t.read()) == 16
    t.append(rows(spark, ("c7", "f", 2), ("c8", "f", 2)), 1)
    assert contents(t.lookup(["c7", "none"])) == [("c7", "f", 2)]


def test_an_append_goes_on_top_of_a_compaction(spark, tmp_path, monkeypatch):
    """The compaction is committed while the delta is written; both count."""
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", "f", 1), ("b", "f", 1)), 0)
    write, other = KeyedTable._write, table(spark, tmp_path)

    def slow(self, *args):
        made = write(self, *args)
        if self is t:
            other.compact()
        return made

    monkeypatch.setattr(KeyedTable, "_write", slow)
    assert t.append(rows(spark, ("a", "f", 2)), 1)
    assert contents(t.read()) == [("a", "f", 2), ("b", "f", 1)] and list(t.manifest().deltas) == ["1"]


def test_a_stream_fills_a_table(spark, tmp_path):
    from callmetrics.streaming import run_available

    for i in range(5):
        rows(spark, *[(f"c{j}", "f", i) for j in range(i, i + 3)]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    t = table(spark, tmp_path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run_available(t.sink(stream, f"{tmp_path}/cp", compact_every=2))
    assert contents(t.read()) == [(f"c{j}", "f", min(j, 4)) for j in range(7)] and len(t.manifest().deltas) < 2


def test_objects_expire_and_are_fetched_from_the_archive(spark, tmp_path):
    """Objects live for a day; a later reference falls back to where they came from."""
    from datetime import datetime, timedelta

    from callmetrics.sources.records import with_fallback

    now = datetime(2026, 1, 3)
    objects = KeyedTable(spark, f"file://{tmp_path}/o", "object_key string, content binary, at timestamp", ["object_key"], ["at"], by="object_key", buckets=4)
    given = [(f"c{i}.flac", bytes([i]), now - timedelta(hours=10 * i)) for i in range(6)]
    objects.append(spark.createDataFrame(given, "object_key string, content binary, at timestamp"), 0)
    objects.compact(keep=F.col("at") >= F.lit(now) - F.expr("INTERVAL 24 HOURS"))
    assert sorted(r["object_key"] for r in objects.read().collect()) == ["c0.flac", "c1.flac", "c2.flac"]
    archive = spark.createDataFrame([("c3.flac", b"old"), ("c4.flac", b"old")], "object_key string, content binary")
    found = with_fallback(spark.createDataFrame([(k,) for k in ("c1.flac", "c3.flac", "c5.flac")], "object_key string"), objects.read(), archive)
    assert {r["object_key"]: (r["content"] and bytes(r["content"]), r["error_code"]) for r in found.collect()} == {"c1.flac": (b"\x01", None), "c3.flac": (b"old", None), "c5.flac": (None, "OBJECT_MISSING")}


def test_an_append_shuffles_once(spark, tmp_path):
    """Rows go to their buckets as they are; what is the last of a key is seen by reads and compactions."""
    t = table(spark, tmp_path)
    batch = rows(spark, *[("a", "f", n) for n in range(5)], ("b", "f", 1), (None, "f", 2), (None, "f", 1))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("append", "append")
    t.append(batch, 0)
    spark.sparkContext.setJobGroup("other", "other")
    stages = {s for j in tracker.getJobIdsForGroup("append") for s in tracker.getJobInfo(j).stageIds}
    run = [s for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert len(run) == 2  # rows to the shuffle, and from it to files
    want = sorted([(None, "f", 2), ("a", "f", 4), ("b", "f", 1)], key=repr)
    assert contents(t.read()) == want
    t.compact()
    assert contents(t.read()) == want and spark.read.parquet(*[f"{t.path}/{p}" for p in t.manifest().base.values()]).count() == 3


def test_the_last_row_of_a_key(spark):
    """Nulls come first in the order, and the later column decides among equals; a key with many rows is thinned before the shuffle."""
    df = spark.createDataFrame([("a", None, 9), ("a", 1, 1), ("a", 1, 2), (None, None, None), (None, None, 3), ("n", None, None)], "k string, x int, y int")
    out = _last(df, ["k"], ["x", "y"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", 1, 2), (None, None, 3), ("n", None, None)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Partial" in plan[plan.rindex("Exchange") :]

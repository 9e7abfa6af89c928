"""Views of a fleet of functions: groups and topics, lags, frequencies, mixes of status, one call's trace, and ranks of large groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds_between, split_group
from ..schemas import HYDRATOR
from ..shared import kept
from .accounting import function_tally, group_lag, lag_seconds, unaccounted
from .delivery import answered, call_trace, valid_result

TERMINAL = ("call.completed", "call.dead_lettered")


# Groups and topics -----------------------------------------------------------------------------------------------


def topics_by_name(topics: DataFrame, prefix: str = "calls.") -> DataFrame:
    """The topics of this system, by name."""
    return topics.filter(F.col("name").startswith(prefix)).orderBy("name")


def dead_letter_topics(topics: DataFrame, prefix: str = "calls.") -> DataFrame:
    """Topics of dead letters."""
    return topics.filter(F.col("name").startswith(prefix) & F.contains("name", F.lit(".dlq.")))


def worker_groups(groups: DataFrame, hidden: tuple[str, ...] = ("console", "monitor")) -> DataFrame:
    """Groups without those of the tools, whose names begin with `hidden`; function_id and version are split at the first colon."""
    tool = F.lit(False)
    for name in hidden:
        tool = tool | F.col("group_id").startswith(name)
    function, version = split_group(F.col("group_id"))
    return groups.filter(~tool).withColumns({"function_id": function, "function_version": version})


def fleet(offsets: DataFrame, hidden: tuple[str, ...] = ("console", "monitor")) -> DataFrame:
    """Lag of each worker group, the largest first, then by name."""
    return worker_groups(group_lag(offsets), hidden).orderBy(F.desc("lag"), "group_id")


def worst_lag(lags: DataFrame) -> DataFrame:
    """The group with the largest lag; of equal ones the first by name."""
    return lags.groupBy("lag").agg(F.min("group_id").alias("group_id")).agg(F.max_by(F.struct("group_id", "lag"), "lag").alias("x")).select("x.*").filter("lag IS NOT NULL")


def behind(samples: DataFrame, limit: float = 3600.0) -> DataFrame:
    """For each time of the samples (group_id, at, lag, rate): how many groups are further behind than `limit` seconds. An endless lag counts, one that is not a number doesn't."""
    late = lag_seconds(F.col("lag"), F.col("rate"))
    return samples.groupBy("at").agg(F.count_if(~F.isnan(late) & (late > limit)).alias("n_behind"), F.count("*").alias("groups"))


# Results, letters and events -------------------------------------------------------------------------------------


def codes_by_frequency(dead_letters: DataFrame) -> DataFrame:
    """Error codes of all dead letters, the most frequent first, then by name; no code reads ?."""
    return dead_letters.groupBy(F.coalesce("error_code", F.lit("?")).alias("error_code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_code")


def undecodable(results: DataFrame) -> DataFrame:
    """Of each function the results whose envelope is not valid, and all."""
    return results.groupBy("function_id").agg(F.count_if(~valid_result()).alias("undecodable"), F.count("*").alias("results"))


def status_mix(results: DataFrame, every: str = "1 minute") -> DataFrame:
    """Results by window, function, version and status."""
    out = results.groupBy(F.window("completed_at", every).alias("w"), "function_id", "function_version", "status").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "function_id", "function_version", "status", "n")


def outcomes(events: DataFrame, reason: Column) -> DataFrame:
    """Events by function, name and reason (an error code or a status); no reason reads ?."""
    return events.groupBy("function_id", "event_name", F.coalesce(reason, F.lit("?")).alias("reason")).agg(F.count("*").alias("n"))


def terminal_events(events: DataFrame, since: Column | None = None, names: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Completed and dead-lettered events, later than `since` if given: what a live tail shows next. Works on streams, too."""
    found = events.filter(F.col("event_name").isin(*names))
    return found.filter(F.col("at") > since) if since is not None else found


def recent_for_function(events: DataFrame, order: list[str], most: int = 10, names: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The newest terminal events of each function, as `place` 1 to `most`. Rows are thinned within salted groups first, so a large function is no burden."""
    ranked = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    some = terminal_events(events, names=names).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    some = some.withColumn("_i", ranked("function_id", "_salt")).filter(F.col("_i") <= most)
    return some.withColumn("place", ranked("function_id")).filter(F.col("place") <= most).drop("_salt", "_i")


def usable_recordings(manifest: DataFrame) -> DataFrame:
    """Recordings that are expected to hydrate and have a file."""
    return manifest.filter((F.col("expect") == "hydrates") & (F.coalesce("filename", F.lit("")) != ""))


def aligned_frames(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Values of two analyzers of the same 20 ms frames: call_id, frame_idx, and one column each from `value`."""
    side = lambda df, name: df.select("call_id", "frame_idx", F.col("value").alias(name))
    return side(left, names[0]).join(side(right, names[1]), ["call_id", "frame_idx"])


def trace_of(calls: list[str], references: DataFrame, results: DataFrame, dead_letters: DataFrame, declarations: DataFrame, order: list[str]) -> DataFrame:
    """The trace of some calls. Each side is filtered before it is joined; what is read for that is the sides' affair: give the `lookup` of keyed tables, which opens the calls' buckets alone."""
    mine = F.col("call_id").isin(*calls)
    return call_trace(references.filter(mine), results.filter(mine), dead_letters.filter(mine), declarations, order)


def full_report(expected: DataFrame, results: DataFrame, dead_letters: DataFrame, functions: DataFrame) -> DataFrame:
    """One row a function: its tally, dead letters, undecodable results, missing calls with examples; expected, hydration failures and reachable calls of all; whether all is accounted for.

    Results have payload and payload_ref. Write it as JSON with `df.write.json`.
    """
    failed = dead_letters.filter(F.col("function_id") == HYDRATOR).select("call_id").distinct()
    calls = expected.select("call_id").distinct()
    whole = calls.join(failed.withColumn("f", F.lit(True)), "call_id", "left").agg(F.count("*").alias("expected"), F.count("f").alias("hydration_failures"))
    tally = function_tally(results, expected.select("call_id", F.col("duration_seconds").alias("seconds"))).select("function_id", "results", "unique_calls", "duplicates", "success", "failed", "skipped", "max_attempt", "audio_seconds")
    dlq = dead_letters.groupBy("function_id").agg(F.countDistinct("call_id").alias("dlq_calls"))
    gone = unaccounted(expected, failed, answered(results, dead_letters), functions)
    df = functions.select("function_id").distinct()
    for part in (tally, dlq, undecodable(results).drop("results"), gone):
        df = df.join(part, "function_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counts = ("results", "unique_calls", "duplicates", "success", "failed", "skipped", "dlq_calls", "undecodable", "n_missing")
    df = df.select("function_id", *[n(c) for c in counts], "max_attempt", F.coalesce("audio_seconds", F.lit(0.0)).alias("audio_seconds"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    df = df.withColumn("_whole", whole.select(F.struct("expected", "hydration_failures")).scalar())
    df = df.select("*", "_whole.*").drop("_whole").withColumn("reachable", F.col("expected") - F.col("hydration_failures"))
    return df.withColumn("passed", (F.col("n_missing") == 0) & (F.col("duplicates") == 0) & (F.col("undecodable") == 0))


# Ranks and quantiles ---------------------------------------------------------------------------------------------


#: Values of a key, or of a range of its values, that one task may sort.
SORTED_AT_ONCE = 1 << 20
#: Points that cut a range of values that is too large.
CUTS = 64


def _numbers(df: DataFrame, key: list[str], value: str) -> DataFrame:
    return df.select(*key, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")


def _within(rows: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """Values with the ranges of their key that hold them; null keys are keys, too."""
    side = ranges.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], *[c for c in ranges.columns if c not in key])
    same = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    for i, k in enumerate(key):
        same = same & rows[k].eqNullSafe(F.col(f"_key{i}"))
    return rows.join(side, same).drop(*[f"_key{i}" for i in range(len(key))])


def ranges_at(rows: DataFrame, key: list[str], wanted: Column, bound: int) -> DataFrame:
    """Ranges of values (_low to _high, with _before values below and _n inside) that hold the wanted places `_w`; of each at most `bound` values, or all of one value.

    A range that holds more is cut at `CUTS` approximate quantiles and at values that equal one, and the parts that hold a
    place are kept, so each round leaves about a 64th, however the values lie. A row a key and place is written each round.
    """
    whole = rows.groupBy(*key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.lit(0).cast("long").alias("_before"), F.count("*").alias("_n"))
    ranges = kept(whole.withColumns({"_total": F.col("_n"), "_w": wanted}), "ranges")
    large = (F.col("_n") > bound) & (F.col("_low") < F.col("_high"))
    while not (big := ranges.filter(large)).isEmpty():
        ids = [*key, "_low", "_high"]
        cuts = _within(rows, big.select(*ids), key).groupBy(*ids).agg(F.percentile_approx("_v", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("_cuts"))
        same = F.lit(True)
        named = cuts.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(ids)], F.array_distinct("_cuts").alias("_cuts"))
        for i, c in enumerate(ids):
            same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
        cut = kept(big.join(named, same).select(*big.columns, "_cuts"), "cuts")
        # Even parts lie between cuts, odd ones are a cut's own value.
        part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        group = [*key, "_before", "_total", "_w"]
        parts = _within(rows, cut, key).withColumn("_part", part).groupBy(*group, "_part").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*key, "_before").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("_before", F.col("_before") + below)
        parts = parts.withColumn("_w", F.filter("_w", lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_n")))).filter("size(_w) > 0")
        ranges = kept(ranges.filter(~large).unionByName(parts.select(*ranges.columns)), "ranges")
    return ranges


def _values_at(df: DataFrame, key: list[str], value: str, places: dict[str, Callable[[Column], Column]], bound: int | None) -> DataFrame:
    bound = bound or SORTED_AT_ONCE
    rows = kept(_numbers(df, key, value), "values")
    wanted = lambda total: F.array(*[F.struct(F.lit(name).alias("name"), place(total).cast("long").alias("at")) for name, place in places.items()])
    largest = rows.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if largest <= bound:
        counted, part = rows.groupBy(*key, "_v").agg(F.count("*").alias("_n")), Window.partitionBy(*key)
        ranked = counted.withColumns({"_upto": F.sum("_n").over(part.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_n").over(part)})
        at = {name: place(F.col("_total")).cast("long") for name, place in places.items()}
        return ranked.groupBy(*key, "_total").agg(*[F.min(F.when(at[name] < F.col("_upto"), F.col("_v"))).alias(name) for name in places])
    ranges = ranges_at(rows, key, wanted(F.col("_n")), bound)
    inside = _within(rows, ranges, key).groupBy(*key, "_total", "_before", "_w", "_v").agg(F.count("*").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*key, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_upto", upto)

    def reached(name: str) -> Column:
        return F.exists("_w", lambda w: (w["name"] == name) & (w["at"] < F.col("_upto")))

    return ranked.groupBy(*key, "_total").agg(*[F.min(F.when(reached(name), F.col("_v"))).alias(name) for name in places])


def values_at(df: DataFrame, key: list[str], value: str, places: dict[str, Callable[[Column], Column]], *, bound: int | None = None) -> DataFrame:
    """Of each key the values at places of its sorted order (0 is the least): `places` give each from the number of values.

    Keys of at most `bound` values (`SORTED_AT_ONCE`) are sorted. If one has more, values are narrowed down to ranges that hold a
    place and at most `bound` values first (`ranges_at`), so no task sorts more. Nulls and NaN do not count.
    Each step reads the values once, so they are written first: what made them, a join, say, runs once.
    """
    return _values_at(df, key, value, places, bound).drop("_total")


def nearest_ranks(df: DataFrame, key: list[str], value: str, percents: list[float], *, bound: int | None = None) -> DataFrame:
    """The value at place round-half-even(p / 100 * (n - 1)) of each key, rounded to 4 places: columns p50 and so on."""
    at = {f"p{p:g}": (lambda n, p=p: F.least(n - 1, F.bround(F.lit(p / 100.0) * (n - 1)).cast("long"))) for p in percents}
    return values_at(df, key, value, at, bound=bound).select(*key, *[F.bround(c, 4).alias(c) for c in at])


def quantiles(df: DataFrame, key: list[str], value: str, shares: list[float], *, bound: int | None = None) -> DataFrame:
    """Quantiles of each key, interpolated between neighbours: columns p50 and so on."""
    at, share = {}, {}
    for q in shares:
        name = f"p{q * 100:g}"
        at |= {f"{name}_low": lambda n, q=q: F.floor(F.lit(q) * (n - 1)), f"{name}_high": lambda n, q=q: F.ceil(F.lit(q) * (n - 1))}
        share[name] = q
    found = _values_at(df, key, value, at, bound)
    part = lambda q: F.lit(q) * (F.col("_total") - 1) - F.floor(F.lit(q) * (F.col("_total") - 1))
    return found.select(*key, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part(q)).alias(n) for n, q in share.items()])


def multiples(results: DataFrame, audio: DataFrame) -> DataFrame:
    """Each result with its realtime multiple: audio seconds over processing seconds, null where either is not positive.

    Sides are merged at every size: audio that is just small enough to be broadcast is no smaller for each executor.
    """
    df = results.join(audio.select("call_id", "duration_seconds").hint("merge"), "call_id")
    took = seconds_between("started_at", "completed_at")
    return df.withColumn("multiple", F.when((F.col("duration_seconds") > 0) & (took > 0), F.col("duration_seconds") / took))


# Alerts ----------------------------------------------------------------------------------------------------------


def _for(flag: Column, key: list[str], k: int) -> Column:
    """Whether a flag has held in each of the last k samples of its key, in order of `at`."""
    w = Window.partitionBy(*key).orderBy("at").rowsBetween(1 - k, 0)
    return (F.min(flag.cast("int")).over(w) == 1) & (F.count("*").over(w) == k)


def dead_letter_alerts(samples: DataFrame, most: float = 0.1, sustained: int = 10) -> DataFrame:
    """Samples (function_id, at, rate of dead letters a second) with `alert`: above `most` in each of the last samples."""
    return samples.select("function_id", "at", "rate", _for(F.coalesce(F.col("rate") > most, F.lit(False)), ["function_id"], sustained).alias("alert"))


def slow_alerts(samples: DataFrame, floor: float = 25.0, sustained: int = 30) -> DataFrame:
    """Samples (function_id, at, multiple: the median) with `alert`: below the floor in each of the last samples."""
    return samples.select("function_id", "at", "multiple", _for(F.coalesce(F.col("multiple") < floor, F.lit(False)), ["function_id"], sustained).alias("alert"))


# Offsets of streams ----------------------------------------------------------------------------------------------


def progress_offsets(progress: DataFrame) -> DataFrame:
    """Offsets from progress reports of streaming queries (group_id, json): group_id, topic, partition, committed, low, high.

    The end of a batch is what the query has taken, the latest offset what is there; both are offsets by topic and
    partition, as Kafka sources report them. Of several reports of a group the last batch counts.
    """
    at = "MAP<STRING, MAP<STRING, BIGINT>>"
    report = F.from_json("json", "batchId BIGINT, sources ARRAY<STRUCT<endOffset: STRING, latestOffset: STRING>>")
    last = progress.select("group_id", report.alias("r")).groupBy("group_id").agg(F.max_by("r", F.col("r.batchId")).alias("r"))
    source = last.select("group_id", F.explode("r.sources").alias("s")).select("group_id", F.from_json("s.endOffset", at).alias("done"), F.from_json("s.latestOffset", at).alias("there"))
    topics = source.select("group_id", "done", F.explode("there").alias("topic", "high"))
    parts = topics.select("group_id", "topic", F.col("done")[F.col("topic")].alias("done"), F.explode("high").alias("partition", "high"))
    return parts.select("group_id", "topic", F.col("partition").cast("int").alias("partition"), F.coalesce(F.col("done")[F.col("partition")], F.lit(-1)).cast("long").alias("committed"), F.lit(0).cast("long").alias("low"), "high")

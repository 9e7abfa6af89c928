"""Operator 6, URL filters: rules, and propagation over the hosts' link graph.

A rule names a host and the beginning of a path; it fits the host itself and all its subdomains, and the longest
rule that fits decides. Where no rule fits, the host decides: trust flows from hosts with allowed pages along links
(personalised PageRank), distrust flows from hosts with blocked pages against them, since who links to bad hosts is
suspect. What a host without links would pass on goes back to the seeds. A host whose distrust exceeds its trust `BLOCK_ABOVE`
times is blocked, any other allowed: at 1, a host of its own with blocked pages and no allowed one is blocked as a whole.

Links are counted by pair of hosts before anything is joined. Null urls and urls without `://` have an empty host
and path, fit no rule and are allowed unless the empty host earns distrust. A null html has no links. Repeated pages
are judged each for itself and count once each as seeds. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host is blocked if its distrust is more than so many times its trust.
BLOCK_ABOVE = 1.0
#: Up to so many rules are one expression; more are joined by the ends of the hosts' names, with the same result.
EXPRESSION_RULES = 256
#: Rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*([a-z][a-z0-9+.\-]*://[^"'\s>]+|//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str  # host and beginning of the path

    def fits(self) -> Column:
        host, slash, rest = self.name.partition("/")
        host = host.translate(str.maketrans(_UPPER, _LOW))
        at = F.col("host")
        return ((at == host) | at.endswith("." + host)) & F.col("path").startswith(slash + rest)


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4))


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule], url_column: str = "url") -> DataFrame:
    """The rows with `host`, `path`, and the `rule` and `rule_verdict` of the longest rule that fits, else null.

    Of rules of equal length one that blocks comes first, then the first by name. Columns of these names are replaced.
    """
    if len(rules) > EXPRESSION_RULES:
        return _joined(pages, rules, url_column)
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    url = F.col(url_column)
    # The url is parsed before columns named host or path could be taken for it.
    df = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict")], host_of(url).alias("host"), path_of(url).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(ordered):
        rule, verdict = F.when(r.fits(), r.name).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _joined(pages: DataFrame, rules: list[Rule], url_column: str) -> DataFrame:
    """`ruled` for a long list: each host meets the rules of its own name and of those that it is below, its pages choose among them."""
    url, keep = F.col(url_column), [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict")]
    df = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    parts = [(r.name.partition("/")[0].translate(str.maketrans(_UPPER, _LOW)), "".join(r.name.partition("/")[1:]), len(r.name), 0 if r.verdict == "block" else 1, r.name, r.verdict) for r in rules]
    table = pages.sparkSession.createDataFrame(parts, "end string, begin string, size int, late int, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = F.struct((-F.col("size")).alias("size"), "late", "rule", "rule_verdict", "begin")
    found = df.select("host").distinct().select("host", F.explode(ends).alias("end")).join(table, "end").groupBy("host").agg(F.array_sort(F.collect_set(rows)).alias("fitting"))
    best = F.get(F.filter("fitting", lambda r: F.col("path").startswith(r["begin"])), F.lit(0))
    return df.join(found, "host", "left").withColumn("best", best).select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Links between different hosts: src, dst, links. Relative links stay on their host and say nothing here."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_column), F.lit(_LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).filter("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """Trust and distrust of each host: host, trust, distrust.

    `seeds` has host, trust_seed and distrust_seed (each sums to 1 or is 0). Each step is written, which cuts the lineage.
    """
    start = seeds.select("host", F.col("trust_seed"), F.col("distrust_seed"))
    if edges.isEmpty():
        return start.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    leaving = edges.groupBy("src").agg(F.sum("links").alias("n_out"))
    coming = edges.groupBy("dst").agg(F.sum("links").alias("n_in"))
    share = edges.join(leaving, "src").join(coming, "dst")
    # One table serves both walks: along links for trust, against them for distrust.
    steps = written(
        share.select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("n_out")).alias("with_link"), F.lit(0.0).alias("against"))
        .unionByName(share.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("with_link"), (F.col("links") / F.col("n_in")).alias("against"))),
        "host-steps",
    )
    hosts = steps.groupBy(F.col("from").alias("host")).agg((F.sum("with_link") == 0).alias("no_out"), (F.sum("against") == 0).alias("no_in"))
    known = seeds.select("host").distinct().join(hosts, "host", "full_outer")
    start = written(known.join(start, "host", "left").fillna(0.0).fillna(True), "host-seeds")
    state = start.select("host", "no_out", "no_in", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    for _ in range(iterations):
        stuck = state.agg(F.sum(F.when(F.col("no_out"), F.col("trust"))), F.sum(F.when(F.col("no_in"), F.col("distrust")))).first()
        sent = steps.join(state, steps["from"] == state["host"]).groupBy("to").agg(F.sum(F.col("trust") * F.col("with_link")).alias("t"), F.sum(F.col("distrust") * F.col("against")).alias("d"))
        new = lambda seed, got, back: (1 - damping + damping * (back or 0.0)) * F.col(seed) + damping * F.coalesce(got, F.lit(0.0))
        state = start.join(sent, start["host"] == sent["to"], "left").select("host", "no_out", "no_in", new("trust_seed", "t", stuck[0]).alias("trust"), new("distrust_seed", "d", stuck[1]).alias("distrust"))
        state = written(state, "host-trust")
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[Rule], *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", iterations: int = 20, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    read = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    fitted = ruled(read, rules)
    edges = written(host_edges(fitted), "host-edges")
    counts = fitted.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
    counts = written(counts, "host-counts")
    part = lambda n: F.coalesce(F.try_divide(F.col(n), counts.agg(F.sum(n)).scalar()), F.lit(0.0))
    seeds = counts.select("host", part("a").alias("trust_seed"), part("b").alias("distrust_seed"))
    scores = propagate(edges, seeds, iterations=iterations)
    bad = scores.filter(F.col("distrust") > block_above * F.col("trust")).select("host", F.lit(True).alias("bad"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return fitted.drop("html", "url").join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: a verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), [Rule(*r) for r in RULES])

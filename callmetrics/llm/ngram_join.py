"""Operator 7, n-gram Jaccard join: vertical partitioning of the global n-gram order.

All n-grams have one order, the rarest first (by quarters of an octave of their frequency, then by hash). The order is
cut into fragments of about equal volume, and every document's set with it: fragments are joined separately, each
counts a part of a pair's overlap, and the parts are summed for each pair.

Which pairs are worth counting follows from the same order. Two sets that are similar enough must share an n-gram
among the first few of both, and how many n-grams they share among these bounds what they can share in all. Sets
with equal members are one class with one representative. Rounds come first in which each representative is compared
with one leader of its first n-grams' lists: in the first round that whose n-grams are the most popular, as the text
from which a family of copies stems is, later one of a component drawn by hash. Rounds go on while components merge.
What is linked by then needs no further pair: the last round takes the pairs of each list that are still in different
components and within the bounds. No link between different components is lost, and a large family of near copies
costs few comparisons.

Documents without words, and null texts, have an empty set and no links. A null doc_id takes part, but names no
component. Repeated rows are equal documents. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .coded import Slice, bands, coded, fragments_for, totals, totals_of, volume_by_band, with_totals
from .scratch import written

#: Fragments of the global order in which overlaps are counted, at least, and n-grams that one set has in a fragment, about.
FRAGMENTS, PART = 4, 1 << 18
#: Another round of leaders follows one that left at most this share of the components apart.
PROGRESS = 0.9


def shingles(s: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document row and hash of each distinct n-gram of each document; fewer words than n make one n-gram."""
    h, doc = s.hashes()[s.number], s.doc
    size = np.diff(s.first)
    grams = [K.gram_hash(h, n)[doc[: len(doc) - n + 1] == doc[n - 1 :]] if len(h) >= n else np.zeros(0, K.U64)]
    rows = [doc[: len(doc) - n + 1][doc[: len(doc) - n + 1] == doc[n - 1 :]] if len(h) >= n else np.zeros(0, np.int64)]
    for k in range(1, n):
        at = np.flatnonzero(size == k)
        if len(at):
            words = h[s.first[at][:, None] + np.arange(k)]
            grams.append(K.mix(sum((words[:, j] * K.U64(pow(int(K._M1), k - 1 - j, 1 << 64)) for j in range(k)), np.full(len(at), k, K.U64)) ^ K._M2))
            rows.append(at)
    gram, row = np.concatenate(grams), np.concatenate(rows)
    _, at, _ = K.distinct(K.mix(gram + row.astype(K.U64) * K._M1))
    return row[at], gram[at]


def _slice_keys(n: int):
    def keys(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        gram = np.sort(shingles(s, n)[1])
        at = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        return gram[at], np.diff(np.append(at, len(gram)))

    return keys


def cuts_of(volume: list[int], fragments: int) -> np.ndarray:
    """Places in the order that cut it into fragments of about equal volume, from the volume of each band of frequencies."""
    ends = np.cumsum([0, *volume]).astype(float)
    at = ends[-1] * np.arange(1, fragments) / fragments
    band = np.clip(np.searchsorted(ends, at, "right") - 1, 0, len(volume) - 1)
    share = (at - ends[band]) / np.maximum(np.diff(ends)[band], 1)
    return (band.astype(K.U64) << K.U64(56)) + np.minimum(share * 2.0**56, 2.0**56 - 256).astype(K.U64)


def _sets(n: int, percent: int, cuts: np.ndarray):
    """For each document: node, doc_id, n_shingles; and where enough of its n-grams are shared: two sums that name its set, how many of its n-grams nobody shares (they stand first), how popular its n-grams are, the others of its prefix, and the shared ones of its set by fragment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Slice.of(batch, k)
                row, gram = shingles(s, n)
                keys, _, inverse = K.distinct(gram)
                df = totals_of(batch, k)[inverse]
                size = np.bincount(row, minlength=len(s.docs))
                need = -(-size * percent // 100)  # n-grams that any similar set shares with this one
                shared = np.bincount(row, df > 1, minlength=len(size)).astype(np.int64)
                enough = (shared >= need) & (size > 0)
                keep = enough[row]
                row, gram, df = row[keep], gram[keep], df[keep]
                band = bands(df)
                order = np.lexsort((gram, band, row))
                row, gram, df, band = row[order], gram[order], df[order], band[order]
                at = np.flatnonzero(enough)
                cut = np.append(0, np.cumsum(size[at]))
                place = np.arange(len(row)) - np.repeat(cut[:-1], size[at])
                early = (place < (size - need + 1)[row]) & (df > 1)
                prefix, ends = gram[early].view(np.int64), np.append(0, np.cumsum(np.bincount(row[early], minlength=len(size))[at]))
                raw = gram[np.lexsort((gram, row))]
                name = [np.add.reduceat(K.mix(raw ^ seed), cut[:-1]).view(np.int64) if len(at) else np.zeros(0, np.int64) for seed in (K._M1, K._M2)]
                there = np.full(len(size), -1)
                there[at] = np.arange(len(at))
                spread = pa.array(there, mask=there < 0)
                common = df > 1
                fragment = np.searchsorted(cuts, (band[common].astype(K.U64) << K.U64(56)) | (gram[common] >> K.U64(8)), "right")
                width = len(cuts) + 1
                each = np.bincount(row[common] * width + fragment, minlength=len(size) * width).reshape(-1, width)[at].reshape(-1)
                parts = pa.BinaryArray.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(np.append(0, np.cumsum(each) * 8).astype("<i4")), pa.py_buffer(gram[common])])
                parts = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), parts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix))
                popular = np.minimum(np.bincount(row, band, minlength=len(size)), 2**31 - 1).astype(np.int32)
                columns = [pa.array(s.nodes()), pa.array(s.docs, mask=~s.valid), pa.array(size), pa.array(name[0]).take(spread), pa.array(name[1]).take(spread), pa.array(size - shared), pa.array(popular), lists.take(spread), parts.take(spread)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "n_shingles", "name1", "name2", "n_alone", "popular", "prefix", "parts"])

    return rows


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], names=["a", "b", "common"])


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets (node, parts) are similar enough: a, b."""
    parts = sets.select("node", F.posexplode("parts").alias("fragment", "part")).filter(F.length("part") > 0)
    left, right = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x")), parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "x", "y")
    counts = both.mapInArrow(_overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    similar = F.expr(f"100 * common >= {percent} * (na + nb - common)")
    return counts.join(pairs, ["a", "b"]).filter(similar).select("a", "b")


def _led(places: DataFrame, draw: Column, close: str) -> DataFrame:
    """Pairs (a, b, na, nb), one for each node: the node and, of its lists' leaders, the one that leads the most of them. Rows of places: gram, node, size, popular, component."""
    rank = F.struct(draw.alias("draw"), "popular", (-F.col("node")).alias("node"))
    lead = places.groupBy("gram").agg(F.max_by(F.struct("node", "size", "component", "popular"), rank).alias("lead"), F.count("*").alias("k")).filter("k > 1")
    lead = lead.select("gram", F.col("lead.node").alias("a"), F.col("lead.size").alias("na"), F.col("lead.component").alias("ca"), F.col("lead.popular").alias("pa"))
    led = places.join(lead, "gram").filter("component <> ca").select("a", F.col("node").alias("b"), "na", F.col("size").alias("nb"), "pa").filter(close)
    led = led.groupBy("a", "b", "na", "nb", "pa").agg(F.count("*").alias("k"))
    best = led.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("k", "pa", -F.col("a"))).alias("x")).select("x.a", "b", "x.na", "x.nb")
    swap = F.col("a") > F.col("b")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")]
    return best.select(*pair).distinct()


def _apart(places: DataFrame, name: str) -> DataFrame:
    """The places in lists whose nodes are in different components."""
    split = places.groupBy("gram").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("gram")
    return written(places.join(split, "gram"), name)


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """The least node that each node of the edges (a, b) can reach: node, component. Large-star and small-star steps until nothing changes."""
    edges = written(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(), "star")
    seen = None
    for _ in range(most):
        # Large star: every larger neighbour of a node is tied to the node's least neighbour or itself.
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct()
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high").select(F.explode(F.array(F.struct("m", F.col("low").alias("x")), F.struct("m", F.col("high").alias("x")))).alias("e"))
        edges = written(small.select(F.col("e.m").alias("low"), F.col("e.x").alias("high")).filter("low < high").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("component"))).distinct()
        seen = now
    raise RuntimeError(f"components have not settled after {most} steps")


def join(docs: DataFrame, n: int = 5, percent: int = 80, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each document: doc_id, n_shingles, component_id. Documents link where 100 * common >= percent * union."""
    slices = coded(docs, id_column=id_column, text_column=text_column)
    tokens, largest = slices.agg(F.sum("n_tokens"), F.max("n_tokens")).first()
    sums = written(totals(slices, _slice_keys(n), fragments_for(tokens or 0)), "shingle-totals")
    cuts = cuts_of(volume_by_band(sums), max(FRAGMENTS, -(-(largest or 0) // PART)))
    schema = "node long, doc_id long, n_shingles long, name1 long, name2 long, n_alone long, popular int, prefix array<long>, parts array<binary>"
    sets = written(with_totals(slices, sums).mapInArrow(_sets(n, percent, cuts), schema), "shingle-sets")
    alone = sets.filter("name1 IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    name = ["n_shingles", "name1", "name2"]
    shared = sets.filter("name1 IS NOT NULL")
    classes = written(shared.groupBy(*name).agg(F.min("node").alias("node"), F.min("doc_id").alias("least")), "set-classes")
    heads = written(shared.select("node", F.col("n_shingles").alias("size"), "n_alone", "popular", "prefix").join(classes.select("node"), "node"), "set-heads")
    members = shared.select("node", "parts")
    close = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    # Rounds of leaders: first over all lists, then over those that are not yet in one component.
    places = heads.select("node", "size", "popular", F.col("node").alias("component"), F.explode("prefix").alias("gram"))
    found = written(links(written(_led(places, F.lit(0), close), "pairs-led"), members, percent), "links-led")
    label = written(components(found), "components")
    relabelled = lambda rows: rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = heads.select("node", "size", "n_alone", "popular", F.posexplode("prefix").alias("i", "gram"))
    now, turn, before = _apart(relabelled(placed), "places-apart"), 0, None
    while (left := now.select("component").distinct().count()) and (before is None or left <= PROGRESS * before):
        turn, before = turn + 1, left
        more = written(links(written(_led(now, F.xxhash64(F.lit(turn), "component"), close), "pairs-led"), members, percent), "links-led")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        label = written(components(found), "components")
        now = _apart(relabelled(now.drop("component")), "places-apart")

    # Last round: pairs of one n-gram's list that are still apart. Common n-grams of the prefixes (by 32 bits of
    # each, with those of one set that agree in these added) bound the overlap, and so does a common n-gram's place in both.
    now = now.select("gram", "node", "size", "component", (F.col("n_alone") + F.col("i")).alias("place"))
    low = F.transform("prefix", lambda g: F.shiftright(g, 32).cast("int"))
    lists = heads.select("node", low.alias("low")).withColumn("twice", F.size("low") - F.size(F.array_distinct("low")))
    now = written(now.join(lists, "node"), "places-last")
    side = lambda x: now.select("gram", F.col("node").alias(x), F.col("size").alias("n" + x), F.col("component").alias("c" + x), F.col("low").alias("low" + x), F.col("twice").alias("t" + x), F.col("place").alias("p" + x))
    need = f"((na + nb) * {percent} + {100 + percent} - 1) div {100 + percent}"
    rest = f"greatest((na * {percent} + 99) div 100, (nb * {percent} + 99) div 100) - 1"
    within = F.expr(f"a < b AND ca <> cb AND {close} AND pa <= na - {need} AND pb <= nb - {need} AND size(array_intersect(lowa, lowb)) + ta + {rest} >= {need}")
    x, y = side("a"), side("b")
    last = written(x.join(y, (x["gram"] == y["gram"]) & within).select("a", "b", "na", "nb").distinct(), "pairs-last")
    if not last.isEmpty():
        found = found.unionByName(written(links(last, members, percent), "links-last"))
        label = written(components(found), "components")

    placed = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "component").select(*name, "component_id"), "set-components")
    return alone.unionByName(shared.select("doc_id", *name).join(named, name, "left").select("doc_id", "n_shingles", "component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: near-duplicate groups of all documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), shared AS (
  SELECT r, gram FROM (SELECT r, gram, count(*) OVER (PARTITION BY gram) AS df FROM s) WHERE df > 1
), p AS (
  SELECT x.r AS a, y.r AS b, count(*) AS common FROM shared x JOIN shared y ON x.gram = y.gram AND x.r <> y.r GROUP BY x.r, y.r
), l AS (
  SELECT a, b FROM p JOIN n na ON p.a = na.r JOIN n nb ON p.b = nb.r WHERE 100 * common >= 80 * (na.n + nb.n - common)
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY reach.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.r = n.r JOIN c ON d.r = c.r
"""

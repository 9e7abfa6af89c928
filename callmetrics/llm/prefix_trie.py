"""Operator 13, conversation prefix trie by fixed-length block hashing.

A node of the trie is a distinct sequence of the first turns of some conversations. Conversations are cut into blocks of
`BLOCK` turns, and grouped by the digest of all turns up to each block's end. Where only one block follows a path, the
turns within it are a chain: all its nodes have the block's members, and nothing inside is compared. Only where siblings
diverge are their distinct blocks, not the conversations, opened and grouped again turn by turn.

A path's digest is the exclusive or of 128-bit hashes of (position, turn), so that digests of blocks add up to digests of
paths in any order, and long conversations are hashed in parts. What a node sums over its subtree is summed over its
members instead: each node counts for its smallest member, so a member brings the sum of the nodes that count for it, less
those above the node. No level waits for another.

Turns are ordered by their number, null first, equal numbers by a hash of the turn. A null role or text is empty. Rows without conversation id
belong to none and are left out. Repeated rows are turns of their own. An empty table has no nodes. Other columns than the
four are not read, so none can clash.

One conversation may hold any share of the turns, one path any share of the conversations: turns are numbered and hashed
by ranges, groups are summed before the shuffle, and the ids that end at a node reach the task that hashes them as
blocks of 65,536, streamed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

BLOCK = 4
#: Places of one conversation that are summed in one group.
PART = 4096
#: Ids that are sent as one row to the task that hashes them.
IDS = 1 << 16


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _running(rows: DataFrame, group: str, at: str, sums: dict[str, tuple[str, str]], part: int) -> DataFrame:
    """Adds running aggregates, the row itself included: name -> (sum or bit_xor, column). Places in a group are distinct and taken `part` at a time, so a long group is many."""
    rows = rows.withColumn("_part", F.floor(F.col(at) / part))
    inside = Window.partitionBy(group, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    make = {"sum": F.sum, "bit_xor": F.bit_xor}
    add = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    whole = rows.groupBy(group, "_part").agg(*[make[how](c).alias(f"_{n}") for n, (how, c) in sums.items()])
    before = whole.withColumns({f"_{n}": make[how](f"_{n}").over(above) for n, (how, _) in sums.items()}).filter("_part > 0")
    found = rows.withColumns({n: make[how](c).over(inside) for n, (how, c) in sums.items()}).join(before, [group, "_part"], "left")
    return found.withColumns({n: add[how](F.col(n), F.coalesce(f"_{n}", F.lit(0))) for n, (how, _) in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (a 128-bit hash of role and text) and size (UTF-8 bytes of the text), written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    # Numbered within ranges of (conversation, turn): a conversation of many turns lies in many ranges.
    rows = written(rows.repartitionByRange(_tasks(rows), "conv_id", "turn", "key").withColumn("range", F.spark_partition_id()), "trie-turns")
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "key")
    above = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(above)).filter("before > 0").drop("n")
    placed = rows.withColumn("pos", F.row_number().over(inside).cast("long")).join(before, ["conv_id", "range"], "left")
    return written(placed.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "size"), "trie-numbered")


def rebuilt(own: DataFrame, *, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first: turns (conv_id, pos, key, size) and conversations (conv_id, n_turns).

    Conversation c takes the first h turns of c - c % family, with h = crc32(c) % (most + 1), in place of its own first h.
    """
    first = F.sort_array(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "key", "size"))))  # `most` at most
    convs = written(own.groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("first")), "trie-conversations")
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    plan = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.cast("int").alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), "first"), "base", "left")  # a base has a few followers
    lead = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("size"))), 1, 0))
    plan = written(plan.select("conv_id", "n", "h", lead.alias("lead")), "trie-plan")
    taken = plan.select("conv_id", F.inline("lead"))
    shift = plan.select("conv_id", "h", (F.size("lead") - F.col("h")).alias("by"))
    kept = own.join(shift, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") + F.col("by")).alias("pos"), "key", "size")
    sizes = plan.select("conv_id", (F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n_turns"))
    return written(taken.select("conv_id", "pos", "key", "size").unionByName(kept), "trie-rebuilt"), sizes


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each conversation and block: its turns, and the digests of the paths to its end (p) and its start (q)."""
    mark = [F.xxhash64(F.lit(lane), "pos", "key").alias(f"h{lane}") for lane in (1, 2)]
    marked = rows.select("conv_id", "pos", *mark, "size", F.floor((F.col("pos") - 1) / BLOCK).alias("k"))
    blocks = marked.groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "size"))).alias("turns"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    paths = _running(written(blocks, "trie-blocks"), "conv_id", "k", {"p1": ("bit_xor", "x1"), "p2": ("bit_xor", "x2")}, PART)
    return written(paths.select("conv_id", "k", "turns", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")), "trie-paths")


def _grouped(blocks: DataFrame, *sums: Column) -> DataFrame:
    return blocks.groupBy("k", "p1", "p2", "q1", "q2").agg(F.first("turns").alias("turns"), *sums)


def _lone(groups: DataFrame) -> DataFrame:
    """Blocks that no sibling diverges from: (k, p1, p2). The only child of its path."""
    return groups.groupBy("k", "q1", "q2").agg(F.count("*").alias("n"), F.min(F.struct("p1", "p2")).alias("p")).filter("n = 1").select("k", "p.p1", "p.p2")


def _opened(groups: DataFrame, names: list[str]) -> DataFrame:
    """A row for each turn of each block: depth, the digest of the path to it (a) and to its parent (b), its size, and what the block has."""
    to = lambda i, lane: F.aggregate(F.slice("turns", F.lit(1), i), F.col(f"q{lane}"), lambda s, t: s.bitwiseXOR(t[f"h{lane}"]))
    each = F.transform(F.sequence(F.lit(1), F.size("turns")), lambda i: F.struct((F.col("k") * BLOCK + i).cast("long").alias("depth"), *[to(i, lane).alias(f"a{lane}") for lane in (1, 2)], *[to(i - 1, lane).alias(f"b{lane}") for lane in (1, 2)], F.element_at("turns", i)["size"].alias("size")))
    return groups.select(*names, F.inline(each))


def _by_node(groups: DataFrame, lone: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes of the blocks: chains as they are, diverging siblings grouped turn by turn."""
    names, node = list(sums), ["depth", "a1", "a2", "b1", "b2"]
    chains = _opened(groups.join(lone, ["k", "p1", "p2"], "left_semi"), names)
    forks = _opened(groups.join(lone, ["k", "p1", "p2"], "left_anti"), names).groupBy(*node).agg(F.first("size").alias("size"), *[c.alias(n) for n, c in sums.items()])
    return chains.select(*node, "size", *names).unionByName(forks.select(*node, "size", *names))


def digests(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end (depth, a1, a2) the SHA-256 of their ids in decimal, ascending, with commas. A hash has to read its ids in order, so one task reads a node's, as a stream of rows of many ids."""
    key = ["depth", "a1", "a2"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [np.asarray(batch.column(i)) for i in range(4)]
            n = batch.num_rows
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            starts = np.flatnonzero(new)
            starts = np.unique(np.concatenate([starts, np.arange(0, n, IDS)]))
            ends = np.append(starts[1:], n)
            ids = [",".join(map(str, columns[3][a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in columns] + [pa.array(ids, pa.string())], names=[*key, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _rows(out)
        if now is not None:
            yield _rows([(*now, state.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*key, "ends_sha256"])

    n = _tasks(ends)
    chunks = ends.select(*key, "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = chunks.mapInArrow(packed, "depth long, a1 long, a2 long, first long, ids string")
    return chunks.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(hashed, "depth long, a1 long, a2 long, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations, from their turns (conv_id, pos from 1, key, size) and all conversations (conv_id, n_turns), with or without turns."""
    blocks = _blocks(rows)
    groups = written(_grouped(blocks, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")), "trie-groups")
    lone = written(_lone(groups), "trie-chains")
    found = _by_node(groups, lone, {"conv_id": F.min("conv_id"), "n_convs": F.sum("n_convs")})
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), *[zero.alias(c) for c in ("a1", "a2")], *[F.lit(None).cast("long").alias(c) for c in ("b1", "b2")], zero.alias("size"), "conv_id", "n_convs")
    nodes = written(found.unionByName(root), "trie-nodes")
    node = ["depth", "a1", "a2"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("a1"), F.col("b2").alias("a2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, node, "left").withColumns({"n_children": F.coalesce("n_children", zero), "value": (F.col("n_convs") - 1) * F.col("size")})
    nodes = written(nodes, "trie-shape")

    # What a member brings to each node that it belongs to, and what of that counts above the node.
    brings = nodes.groupBy("conv_id").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    sums = {"value": F.sum("value"), "leaves": F.sum("leaves")}
    loaded = blocks.join(written(brings, "trie-members"), "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in sums})
    below = _by_node(written(_grouped(loaded, *[c.alias(n) for n, c in sums.items()]), "trie-loads"), lone, sums).select(*node, F.col("value").alias("brought"), "leaves")
    top = brings.agg(F.sum("value").alias("brought"), F.sum("leaves").alias("leaves")).select(zero.alias("depth"), zero.alias("a1"), zero.alias("a2"), "brought", "leaves")
    nodes = _running(nodes, "conv_id", "depth", {"counted": ("sum", "value")}, PART)
    nodes = nodes.join(below.unionByName(top), node, "left").withColumn("saved_tokens", F.col("brought") - F.col("counted") + F.col("value"))

    end = blocks.groupBy("conv_id").agg(F.max_by(F.struct("p1", "p2"), "k").alias("p"))
    ends = sizes.join(end, "conv_id", "left").select(F.col("n_turns").alias("depth"), F.coalesce("p.p1", zero).alias("a1"), F.coalesce("p.p2", zero).alias("a2"), "conv_id")
    nodes = written(nodes.join(digests(ends), node, "left"), "trie-sums")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(parents, ["depth", "b1", "b2"], "left")
    nobody = F.lit(hashlib.sha256().hexdigest())
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of all rebuilt conversations."""
    return trie(*rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, x: list_reduce(list_prepend(xor(s, x), range(1, 9)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))))"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), v AS (
  SELECT DISTINCT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM t
), u AS (
  SELECT v.c, 0 AS part, t.p, t.role, t.txt FROM v JOIN t ON t.c = v.base WHERE t.p <= v.h
  UNION ALL SELECT v.c, 1, t.p, t.role, t.txt FROM v JOIN t ON t.c = v.c WHERE t.p > v.h
), r AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, md5(strlen(role) || ':' || role || txt) AS k, strlen(txt) AS size FROM u
), k AS (
  SELECT c, d, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)) AS key, size FROM r
  UNION ALL SELECT c, 0, '', 0 FROM v
), kp AS (
  SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_end FROM k
), n AS (
  SELECT d, key, any_value(up) AS up, min(c) AS conv, count(*) AS n, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends
  FROM kp GROUP BY d, key
), ch AS (
  SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch USING (d, key)
), s AS (
  SELECT k.d, k.key, sum((m.n - 1) * m.size) AS saved, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM m JOIN k ON k.c = m.conv AND k.d <= m.d GROUP BY ALL
)
SELECT m.conv AS conv_id, CAST(m.d AS BIGINT) AS depth, p.conv AS parent_conv_id, CAST(m.n AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (d, key) LEFT JOIN n p ON p.d = m.d - 1 AND p.key = m.up
"""

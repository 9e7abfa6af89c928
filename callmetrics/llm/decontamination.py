"""Operator 5, benchmark decontamination: a distributed positional inverted index.

The index is partitioned by document. A row of it, a shard, holds some documents' posting lists: the shard's terms in
order of their hashes, and for each term the places, counted over the shard's words, where it stands. Shards are
built where the documents are read and written as a table, so no posting is shuffled.

A query phrase is looked up in each shard: its rarest term there proposes places, and the other terms' lists, moved
by their offsets in the phrase, are intersected with them from the rarest to the most frequent. Each distinct phrase is
looked up once, some at a time, so that a task holds a bounded number of proposals. Phrases come in blocks of bounded
size; each block is one pass over the index whose hits are written before the next block is read, so neither driver
nor executors hold more of the benchmark than a block.

Null or empty texts have no words and are never hit. An item with a null id is ignored; items of equal id count
once. Repeated documents are judged each for itself. An empty benchmark hits nothing, an empty table gives no rows.
Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import written

_INDEX = "shard long, docs binary, valid binary, first binary, terms binary, begins binary, places binary"
#: Words of query phrases that go to the executors at once.
BLOCK_WORDS = 1 << 18
#: Places that are proposed at once, or those of one phrase.
PROPOSALS = 1 << 20


def _terms(column: pa.Array) -> tuple[K.Spans, np.ndarray]:
    t = K.texts(column).lowered()
    w = K.spans(t, K.ALNUM[t.data])
    return w, K.span_hash(t.data, w.start, w.end)


def build(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The index, written: a row for each shard of about `kernel.SLICE_BYTES` of text."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for s in K.slices(batch, 2):
                part, column = s.column(0)[0].as_py(), s.column(1)
                w, h = _terms(s.column(2))
                order = np.argsort(h, kind="stable")
                terms = h[order]
                begins = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
                row = [
                    (part << 32) + n, np.asarray(column.fill_null(0)), np.asarray(column.is_valid()).astype(np.uint8), w.first.astype("<i8"),
                    terms[begins], np.append(begins, len(terms)).astype("<u4"), order.astype("<u4"),
                ]
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in row[1:]], names=["shard", "docs", "valid", "first", "terms", "begins", "places"])

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return written(rows.mapInArrow(shards, _INDEX), "positional-index")


class _Shard:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        raw = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
        view = lambda name, kind: np.frombuffer(raw[name].as_buffer(), kind)
        self.shard, self.docs, self.valid, self.first = raw["shard"].as_py(), view("docs", "<i8"), view("valid", np.uint8).astype(bool), view("first", "<i8")
        self.terms, self.begins, self.places = view("terms", "<u8"), view("begins", "<u4").astype(np.int64), view("places", "<u4").astype(np.int64)
        self.key: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each term's number in the shard, -1 if it isn't there."""
        i = np.searchsorted(self.terms, h)
        there = np.minimum(i, len(self.terms) - 1)
        return np.where((i < len(self.terms)) & (self.terms[there] == h), i, -1) if len(self.terms) else np.full(h.shape, -1)

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the term stands at the place."""
        if self.key is None:
            self.key = np.repeat(np.arange(len(self.terms)) << 32, np.diff(self.begins)) | self.places
        at = term << 32 | np.maximum(place, 0)
        i = np.minimum(np.searchsorted(self.key, at), len(self.key) - 1)
        return (self.key[i] == at) & (place >= 0)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def phrases(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of one length, as rows of term hashes: all (phrase, first place) within one document, some phrases at a time."""
        number = self.find(terms)
        whole = np.flatnonzero((number >= 0).all(axis=1))
        number = number[whole]
        df = self.begins[number + 1] - self.begins[number]
        rank = np.argsort(df, axis=1, kind="stable")
        rarest = np.take_along_axis(number, rank[:, :1], 1)[:, 0]
        n = self.begins[rarest + 1] - self.begins[rarest]
        upto, at = np.cumsum(n), 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PROPOSALS, "right")))
            some = np.arange(at, end)
            phrase = np.repeat(some, n[some])
            place = self.places[K.ranges(self.begins[rarest[some]], n[some])] - np.repeat(rank[some, 0], n[some])
            for k in range(1, terms.shape[1]):
                keep = self.has(number[phrase, rank[phrase, k]], place + rank[phrase, k])
                phrase, place = phrase[keep], place[keep]
            last = place + terms.shape[1] - 1
            keep = (place >= 0) & (self.doc(np.maximum(place, 0)) == self.doc(last))
            yield whole[phrase[keep]], place[keep]
            at = end


def blocks(items: DataFrame, window: int, *, id_column: str = "item_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Items in blocks: (id as text, term hashes); the driver holds one block at a time."""
    block, n = [], 0
    for item, text in items.select(F.col(id_column).cast("string"), text_column).filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).toLocalIterator():
        h = _terms(pa.array([text], pa.string()))[1]
        if len(h):
            block.append((item, h))
            n += len(h)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _plan(block: list[tuple[str, np.ndarray]], window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct windows of each length: rows of term hashes; and the items of each, from where to where in a list."""
    sizes: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for i, (_, h) in enumerate(block):
        grams = np.lib.stride_tricks.sliding_window_view(h, min(window, len(h)))
        at, rows = sizes.setdefault(grams.shape[1], ([], []))
        at.append(np.full(len(grams), i))
        rows.append(grams)
    out = []
    for at, rows in sizes.values():
        grams, item = np.concatenate(rows), np.concatenate(at)
        order = np.lexsort((item, *grams.T))
        grams, item = grams[order], item[order]
        new = np.append(True, (grams[1:] != grams[:-1]).any(axis=1))
        again = np.append(False, ~new[1:] & (item[1:] == item[:-1]))
        first = np.flatnonzero(new)
        keep = np.cumsum(~again)
        out.append((grams[first], np.append(keep[first] - 1, keep[-1]), item[~again]))
    return out


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that touch or overlap within a document, as one."""
    order = np.argsort(first, kind="stable")
    doc, first, last = doc[order], first[order], last[order]
    upto = np.maximum.accumulate(last) if len(last) else last
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > upto[:-1] + 1) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], first[at], upto[np.append(at[1:], len(first)) - 1] if len(at) else last


def hits(index: DataFrame, block: list[tuple[str, np.ndarray]], window: int = 10) -> DataFrame:
    """What a block's windows cover, written: rows shard, row, first, last of runs of words, without item; and shard, row, item of each item with a window there, without places."""
    shared = index.sparkSession.sparkContext.broadcast((_plan(block, window), [item for item, _ in block]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, names = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                s, none = _Shard(batch, row), np.zeros(0, np.int64)
                runs, pairs = (none, none, none), none
                for terms, cut, items in todo:
                    for phrase, place in s.phrases(terms):
                        doc = s.doc(place)
                        part = _merged(doc, place, place + terms.shape[1] - 1)
                        runs = _merged(*(np.concatenate(x) for x in zip(runs, part, strict=True)))
                        both = np.unique(doc * len(terms) + phrase)
                        doc, phrase = np.divmod(both, len(terms))
                        n = cut[phrase + 1] - cut[phrase]
                        pairs = np.unique(np.append(pairs, np.repeat(doc, n) * len(names) + items[K.ranges(cut[phrase], n)]))
                doc, item = np.divmod(pairs, len(names))
                empty = lambda n, kind: pa.nulls(n, kind)
                yield _rows(s.shard, runs[0], empty(len(runs[0]), pa.string()), pa.array(runs[1]), pa.array(runs[2]))
                yield _rows(s.shard, doc, pa.array([names[i] for i in item], pa.string()), empty(len(doc), pa.int64()), empty(len(doc), pa.int64()))

    found = written(index.mapInArrow(look, "shard long, row long, item string, first long, last long"), "hits")
    shared.destroy()
    return found


def _rows(shard: int, row: np.ndarray, item: pa.Array, first: pa.Array, last: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), shard, np.int64)), pa.array(row.astype(np.int64)), item, first, last], names=["shard", "row", "item", "first", "last"])


def documents(index: DataFrame) -> DataFrame:
    """Documents of the index: shard, row, doc_id, n_words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s, docs, valid, first = (batch.column(i)[k] for i in range(4))
                ids, there = np.frombuffer(docs.as_buffer(), "<i8"), np.frombuffer(valid.as_buffer(), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), s.as_py())), pa.array(np.arange(len(ids))), pa.array(ids, mask=there == 0), pa.array(np.diff(np.frombuffer(first.as_buffer(), "<i8")))], names=["shard", "row", "doc_id", "n_words"])

    return index.select("shard", "docs", "valid", "first").mapInArrow(rows, "shard long, row long, doc_id long, n_words long")


def near(index: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """Proximity: documents in which two terms stand at most `distance` words apart, in either order, with the number of such pairs."""
    a, b = (_terms(pa.array([term], pa.string()))[1] for term in (first, second))
    if len(a) != 1 or len(b) != 1:
        raise ValueError("each term must be one word")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = _Shard(batch, row)
                x, y = s.find(a)[0], s.find(b)[0]
                p, q = (np.sort(s.places[s.begins[k] : s.begins[k + 1]]) if k >= 0 else np.zeros(0, np.int64) for k in (x, y))
                doc = s.doc(p)
                low = np.searchsorted(q, np.maximum(p - distance, s.first[doc]) if len(p) else p)
                high = np.searchsorted(q, np.minimum(p + distance, s.first[doc + 1] - 1) if len(p) else p, "right")
                n = np.bincount(doc, high - low - (x == y), minlength=len(s.docs)).astype(np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(s.docs[at], mask=~s.valid[at]), pa.array(n[at])], names=["doc_id", "n_pairs"])

    return index.mapInArrow(look, "doc_id long, n_pairs long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    index = build(docs)
    found = None
    for block in blocks(items, window, block_words=block_words):
        part = hits(index, block, window)
        found = part if found is None else found.unionByName(part)
    base = documents(index)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "shard long, row long, item string, first long, last long")
    before = Window.partitionBy("shard", "row").orderBy("first", "last", "item").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("first").isNotNull(), F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1)))))
    per = found.withColumn("new", new).groupBy("shard", "row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(per, ["shard", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents against all items of the benchmark."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), ks AS (SELECT DISTINCT k FROM grams), dg AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), h AS (
  SELECT dg.r, dg.k, dg.i, grams.item_id FROM dg JOIN grams ON dg.k = grams.k AND dg.gram = grams.gram
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r
), m AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN m ON d.r = m.r
"""

"""Operator 12, vector code compression: product quantisation with norm-of-sum bounds.

A vector's integers are cut into equal parts; each part is replaced by the number of the nearest entry in its part's
codebook. Codebooks are learned in rounds: assign every part, then move each entry to the mean of its parts.

A part keeps the distance to its second nearest entry, a lower bound on all but its own entry, and the round in which
that bound was computed (its stamp). All rounds' codebooks are kept. Later, the bound less the largest net displacement
of another entry, |entry now - entry at the stamp|, is still a lower bound; the net displacement is never above the sum
of the moves since, which entries that swing to and fro make large. Only where the distance to the own entry, computed
anew, is not below that are all entries measured again. Distances are exact integers; ties go to the lower number, and a bound
must be strictly beaten, with a margin for the roots, so bounds change no result.

Vectors that are null or hold nulls or non-finite components are dropped, and so are those whose length is not the
table's (that of the first usable vector by id, of a length that divides into the parts). Null ids come last; repeated
ids are ordered by their components, and each row is coded for itself. With fewer vectors than entries there are as many entries as
vectors. Integers beyond +-2**28 are taken as +-2**28, so that sums of squares stay whole. An empty table gives no rows.
Other columns than the named ones are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

LIMIT = 1 << 28
_STATE = "vec_id long, label int, ints binary, code binary, bound binary, stamp binary, error long, measured long, sums binary"


@dataclass
class Codebooks:
    """The codebooks of all rounds, each (parts, entries, width); the last is the current one."""

    history: list[np.ndarray] = field(default_factory=list)

    @property
    def now(self) -> np.ndarray:
        return self.history[-1]

    def displacement(self, stamp: int) -> np.ndarray:
        """For each part and entry the largest net displacement, since a round, of any other entry."""
        moved = np.sqrt(((self.now - self.history[stamp]).astype(np.float64) ** 2).sum(axis=2))
        if moved.shape[1] == 1:
            return np.zeros_like(moved)
        top = np.sort(moved, axis=1)[:, -2:]
        own = moved == top[:, 1:]
        return np.where(own, top[:, :1], top[:, 1:])

    def digest(self) -> str:
        """SHA-256 of all final components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.now.reshape(-1).tolist())).encode()).hexdigest()


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows (n, width) to entries (entries, width)."""
    width = max(1, x.shape[1])
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if width * (2 * most) ** 2 < 1 << 53:  # products and sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        return np.rint(d).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - book[None, :, i]) ** 2
    return out


def nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of distances the lowest place of the least, the least, and the distance to the second nearest entry."""
    at = d.argmin(axis=1)
    row = np.arange(len(d))
    least = d[row, at]
    if d.shape[1] == 1:
        return at, least, np.full(len(d), np.inf)
    d[row, at] = np.iinfo(np.int64).max
    return at, least, np.sqrt(d.min(axis=1).astype(np.float64))


def assign(x: np.ndarray, books: Codebooks, code: np.ndarray | None, bound: np.ndarray | None, stamp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, bounds, stamps, errors of the parts (n, parts), and how many parts of each row were measured against all entries.

    x: integers (n, parts, width). Without codes every part is measured.
    """
    n, parts, _ = x.shape
    now = len(books.history) - 1
    code = np.zeros((n, parts), np.uint8) if code is None else code.copy()
    error, measured = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
    first = bound is None
    bound = np.zeros((n, parts)) if first else bound.copy()
    stamp = np.zeros((n, parts), np.uint8) if first else stamp.copy()
    moved = [] if first else [books.displacement(s) for s in range(now + 1)]
    for p in range(parts):
        todo = np.arange(n)
        if not first:
            own = ((x[:, p] - books.now[p][code[:, p]]) ** 2).sum(axis=1)
            left = bound[:, p].copy()
            for s in np.unique(stamp[:, p]):
                of = stamp[:, p] == s
                left[of] -= moved[s][p][code[of, p]] * (1 + 1e-9) + 1e-6
            error[:, p] = own
            todo = np.flatnonzero(~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) < left))
        if len(todo):
            code[todo, p], error[todo, p], bound[todo, p] = nearest(distances(x[todo, p], books.now[p]))
            stamp[todo, p] = now
            measured[todo] += 1
    return code, bound, stamp, error, measured


def integers(vectors: DataFrame, parts: int, scale: int, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, int]:
    """Usable vectors as integers (vec_id, label, ints array<long>), and their length; 0 if there is none."""
    scaled = F.transform(F.col(vector_column), lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))
    finite = F.forall(F.col(vector_column), lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    size = F.size(vector_column)
    rows = vectors.filter(F.col(vector_column).isNotNull() & (size > 0) & (size % parts == 0) & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("int").alias("label"), scaled.alias("ints"))
    first = rows.select(F.struct(F.col("vec_id").isNull(), "vec_id", "ints").alias("o"), F.size("ints").alias("n")).agg(F.min_by("n", "o")).first()[0]
    return rows.filter(F.size("ints") == F.lit(first or 0)), first or 0


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, parts, width).astype(np.int64)


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(x.reshape(len(x), -1).astype(kind))
    size = raw.shape[1] * raw.itemsize if len(raw) else 0
    return pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int64) * size), pa.py_buffer(raw)]).cast(pa.binary())


def _round(rows: DataFrame, books: Codebooks, parts: int, width: int, fresh: bool) -> DataFrame:
    """Assigns all rows by the current codebooks. The last batch of a task carries the task's sums, by part and entry: count, then the components."""
    shared, entries = rows.sparkSession.sparkContext.broadcast(books), books.now.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kept = np.zeros((parts, entries, 1 + width), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            if fresh:
                ints = np.asarray(col["ints"].flatten()).astype("<i4")
                x = ints.reshape(-1, parts, width).astype(np.int64)
                code, bound, stamp, error, measured = assign(x, shared.value, None, None, None)
            else:
                x = _matrix(col["ints"], parts, width)
                view = lambda name, kind: np.frombuffer(b"".join(col[name].to_pylist()), kind).reshape(-1, parts)  # noqa: E731, B023
                code, bound, stamp, error, measured = assign(x, shared.value, view("code", np.uint8), view("bound", "<f4").astype(np.float64), view("stamp", np.uint8))
            for p in range(parts):
                sums[p, :, 0] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p, :, 1:], code[:, p], x[:, p])
            if kept is not None:
                yield kept(None)
            low = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))  # a bound may be rounded down only
            columns = [col["vec_id"], col["label"], _bytes(x, "<i4"), _bytes(code, "u1"), _bytes(low, "<f4"), _bytes(stamp, "u1"), pa.array(error.sum(axis=1)), pa.array(measured)]

            def kept(carried: bytes | None, columns: list = columns) -> pa.RecordBatch:
                last = pa.array([None] * (len(columns[0]) - 1) + [carried], pa.binary())
                return pa.RecordBatch.from_arrays([*columns, last], names=[x.split()[0] for x in _STATE.split(", ")])

        if kept is not None:
            yield kept(sums.astype("<i8").tobytes())

    return rows.mapInArrow(step, _STATE)


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: each entry the mean, rounded down, of its parts; unused entries stay. A row for each task is read, a row for each entry's component comes back."""
    cells = book.shape[0] * book.shape[1] * (1 + book.shape[2])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "n"])

    sums = state.filter("sums IS NOT NULL").select("sums").mapInArrow(cell, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(cells, np.int64)
    total[np.asarray(sums.column("cell"))] = np.asarray(sums.column("n"))
    total = total.reshape(book.shape[0], book.shape[1], -1)
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), book)


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, **columns: str) -> tuple[DataFrame, Codebooks]:
    """All usable vectors (vec_id, label, ints, code, error, measured in the last assignment) and the codebooks. `code` has a byte a part."""
    spark = vectors.sparkSession
    if entries > 256 or rounds > 250:
        raise ValueError("a code and a stamp are a byte each")
    rows, size = integers(vectors, parts, scale, **columns)
    if not size:
        return spark.createDataFrame([], _STATE).drop("bound", "stamp", "sums"), Codebooks([np.zeros((parts, 0, 0), np.int64)])
    width = size // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").toArrow()  # as many as a codebook has
    start = np.array(first.column("ints").to_pylist(), np.int64).reshape(-1, parts, width)
    books = Codebooks([np.ascontiguousarray(start.transpose(1, 0, 2))])
    state = rows
    for i in range(rounds + 1):
        state = written(_round(state, books, parts, width, fresh=i == 0), "codes")
        if i < rounds:
            books.history.append(_moved(state, books.now))
    return state.drop("bound", "stamp", "sums"), books


def restored(codes: DataFrame, books: Codebooks, *, scale: int = 256) -> DataFrame:
    """vec_id and the vector that each code stands for."""
    shared = codes.sparkSession.sparkContext.broadcast(books.now)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            book = shared.value
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, book.shape[0])
            x = book[np.arange(book.shape[0])[None], code].reshape(len(code), -1) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(rows, "vec_id long, vector array<float>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: codes of all vectors."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    rows = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    """SQL for each part's nearest entry of a codebook."""
    return f"""SELECT part, r, min(d) AS d, arg_min(entry, d * 64 + entry) AS entry FROM (
    SELECT x.part, x.r, c.entry, list_sum(list_transform(list_zip(x.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM x JOIN {book} c USING (part)
  ) GROUP BY part, r"""


def _next(assigned: str, book: str) -> str:
    """SQL for the codebook after an assignment."""
    return f"""SELECT c.part, c.entry, coalesce(m.q, c.q) AS q FROM {book} c LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS q FROM (
      SELECT a.part, a.entry, i, CAST(sum(x.q[i]) AS DOUBLE) AS s, count(*) AS n
      FROM {assigned} a JOIN x USING (part, r), range(1, 5) AS w(i) GROUP BY ALL
    ) GROUP BY part, entry
  ) m ON m.part = c.part AND m.entry = c.entry"""


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS (
  SELECT r, p AS part, q[4 * p + 1 : 4 * p + 4] AS q FROM v, range(0, 16) AS t(p)
), c0 AS (
  SELECT part, r - 1 AS entry, q FROM x WHERE r <= 64
), a0 AS MATERIALIZED ({_assigned("c0")}
), c1 AS MATERIALIZED ({_next("a0", "c0")}
), a1 AS MATERIALIZED ({_assigned("c1")}
), c2 AS MATERIALIZED ({_next("a1", "c1")}
), a2 AS MATERIALIZED ({_assigned("c2")}
), s AS (
  SELECT r, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r
), h AS (
  SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2
)
SELECT v.vec_id, s.code, s.error, CAST(sum(s.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN s USING (r), h
"""

"""A keyed table: rows by bucket of a column's hash, deltas of micro-batches, compaction, erasure, and look-ups that open one bucket.

Files are written once and never changed. A manifest, a small JSON file with a number, names the folders that make up the
table at that number: for each bucket the folder of its last compaction, and the deltas since. A commit writes the next
manifest, which succeeds for one writer alone; readers take the last one. What a job wrote before it was lost is named by no manifest
and so never seen, and who reads an older manifest still finds its folders until `vacuum`.

A read costs the compacted rows and the deltas since, however many batches there were. Rows of one `by` value are in one
bucket, so a look-up opens that bucket's files only, and an erasure rewrites only the buckets that hold an erased value; a
bucket that has no row left is named no more.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter


def _last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`. Rows are thinned before they are shuffled, so a key with many rows is no burden; they stay as Spark keeps them, not as structs."""
    at = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(at)).filter("_place = 1").drop("_place")


class CommitConflict(RuntimeError):
    """Another writer has committed in the meantime; nothing was changed."""


@dataclass
class Manifest:
    """What a version of the table consists of. `base`: bucket to folder; `deltas`: batch to folder, in the order of commits."""

    version: int = 0
    base: dict[int, str] = field(default_factory=dict)
    deltas: dict[str, str] = field(default_factory=dict)

    def json(self) -> str:
        return json.dumps({"version": self.version, "base": self.base, "deltas": self.deltas})

    @staticmethod
    def of(raw: str) -> Manifest:
        m = json.loads(raw)
        return Manifest(m["version"], {int(b): p for b, p in m["base"].items()}, m["deltas"])


class KeyedTable:
    """The last row of each key by `order`; of rows that are equal in it the later batch's. Null keys are keys, too.

    schema: the rows' schema, as DDL. `key` begins with `by` as a rule; rows of one `by` share a bucket of `buckets`.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], *, by: str = "call_id", buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.by, self.buckets = spark, path.rstrip("/"), key, order, by, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests -------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The last manifest, or that of a version; an empty one if nothing was committed."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return Manifest()
        rows = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True)
        return Manifest.of(rows.first()[0])

    def _commit(self, seen: Manifest, base: dict[int, str], deltas: dict[str, str]) -> Manifest:
        """Puts the next manifest in place, whole or not at all."""
        new = Manifest(seen.version + 1, base, deltas)
        draft, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{new.version:020d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(new.json().encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {new.version} of {self.path} is there already")
        return new

    # Writing ---------------------------------------------------------------------------------------------------------

    def bucket(self, value: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by) if value is None else value), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> str:
        """Rows below a new folder, one folder a bucket; Spark splits buckets that are too large for a task."""
        placed = rows.select(*self.schema.names, self.bucket().alias("_bucket")).hint("rebalance", "_bucket")
        placed.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def append(self, batch: DataFrame, batch_id: int | str) -> bool:
        """Adds a batch's rows as they are, with one shuffle: reads and compactions take the last of each key. A batch that is there already changes nothing, so a stream may run it again."""
        seen, folder = self.manifest(), None
        while str(batch_id) not in seen.deltas and not self._compacted(str(batch_id)):
            folder = folder or self._write(batch, f"delta-{uuid.uuid4().hex}")
            try:
                self._commit(seen, seen.base, seen.deltas | {str(batch_id): folder})
                return True
            except CommitConflict:  # a compaction, say: what was written goes on top of it
                newer = self.manifest()
                if newer.version == seen.version:
                    raise
                seen = newer
        return False

    def _compacted(self, batch_id: str) -> bool:
        return self._fs.exists(self._path(f"batches/{batch_id}"))

    def compact(self, erasures: DataFrame | None = None, keep: Column | None = None) -> Manifest:
        """Merges the deltas into the buckets that they touch, and leaves out rows whose `by` is erased, from the buckets that hold such rows. Other buckets' files stay.

        With `keep`, a condition, rows that do not meet it expire, from all buckets.
        """
        seen = self.manifest()
        touched = self._buckets_of(seen)
        gone = None
        if erasures is not None:
            gone = erasures.select(self.by).filter(F.col(self.by).isNotNull()).distinct()
            held = {r[0] for r in gone.select(self.bucket().alias("b")).distinct().collect()}  # as many as buckets at most
            touched |= held & (set(seen.base) | touched)
        if keep is not None:
            touched |= set(seen.base)
        if not touched:
            return seen
        rows = self._rows(seen, touched)
        if keep is not None:
            rows = rows.filter(F.coalesce(keep, F.lit(False)))
        if gone is not None:
            rows = rows.join(gone, self.by, "left_anti")
        folder = self._write(rows, f"base-{uuid.uuid4().hex}")
        made = self._folders(folder)
        base = {b: p for b, p in seen.base.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in made}
        for batch in seen.deltas:  # what was merged is remembered without the manifest growing
            out = self._fs.create(self._path(f"batches/{batch}"), True)
            out.close()
        return self._commit(seen, base, {})

    def _folders(self, name: str) -> set[int]:
        """Buckets below a folder."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(name)))
        return {int(n.split("=")[1]) for n in names if n.startswith("_bucket=")}

    def _buckets_of(self, m: Manifest) -> set[int]:
        """Buckets that the deltas of a version hold rows of."""
        return set().union(*[self._folders(p) for p in m.deltas.values()])

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests but the last `keep`, and the buckets and deltas that none of these names; how many folders went. Only when no job is writing."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        used = {p for m in kept for p in (*m.base.values(), *m.deltas.values())}
        within = {p.split("/")[0] for p in used}
        gone = 0
        for s in self._fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith(("base-", "delta-")) and name not in within:
                gone += bool(self._fs.delete(s.getPath(), True))
            elif name.startswith("base-"):
                for b in self._folders(name):
                    if f"{name}/_bucket={b}" not in used:
                        gone += bool(self._fs.delete(self._path(f"{name}/_bucket={b}"), True))
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:020d}.json"), False)
        return gone

    def sink(self, stream: DataFrame, checkpoint: str, compact_every: int = 50) -> DataStreamWriter:
        """A stream's rows to the table, batch by batch, compacted every so many batches: readers never find more deltas than that."""

        def step(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if len(self.manifest().deltas) >= compact_every:
                self.compact()

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

    # Reading ---------------------------------------------------------------------------------------------------------

    def _rows(self, m: Manifest, only: set[int] | None = None) -> DataFrame:
        """The last row of each key of a version, or of some of its buckets."""
        base = [f"{self.path}/{p}" for b, p in sorted(m.base.items()) if only is None or b in only]
        rows = self.spark.read.schema(self.schema).parquet(*base) if base else self.spark.createDataFrame([], self.schema)
        deltas = [(i, f"{self.path}/{p}/_bucket={b}") for i, p in enumerate(m.deltas.values()) for b in sorted(self._folders(p)) if only is None or b in only]
        if not deltas:
            return rows  # compacted: a key once
        number = F.create_map(*[x for i, p in enumerate(m.deltas.values()) for x in (F.lit(p.removeprefix("delta-")), F.lit(i))])
        read = self.spark.read.schema(self.schema).parquet(*[p for _, p in deltas])
        newer = read.withColumn("_batch", number[F.substring(F.substring_index(F.col("_metadata.file_path"), "/delta-", -1), 1, 32)])
        return _last(rows.withColumn("_batch", F.lit(-1)).unionByName(newer), self.key, [*self.order, "_batch"]).select(*self.schema.names)

    def read(self, *, version: int | None = None) -> DataFrame:
        """The table, or a version of it that was not vacuumed."""
        return self._rows(self.manifest(version))

    def lookup(self, values: list[str], *, version: int | None = None) -> DataFrame:
        """The rows of some values of `by`: only the files of their buckets are opened."""
        asked = self.spark.createDataFrame([(v,) for v in values], T.StructType([self.schema[self.by]]))
        only = {r[0] for r in asked.select(self.bucket().alias("b")).distinct().collect()}  # values asked for
        return self._rows(self.manifest(version), only).filter(F.col(self.by).isin(*values))

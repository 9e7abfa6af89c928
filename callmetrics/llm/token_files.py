"""Operator 1, token-ID output: fixed-width bit packing.

A file holds ids in the minimum number of bits for its vocabulary, in blocks of a fixed number of ids:

    magic | packed blocks | document ids, document validity, document starts, block offsets | trailer | magic

Document starts count ids within the file; block offsets count bytes. Any range of ids is read by way of its
blocks alone, and a block is unpacked by one vectorised shift and mask.

Documents are range-partitioned and sorted by id, and by a hash of the text where ids are equal, so the files, in order
of their names, hold all documents in ascending order of doc_id, and an id or a row that is a third of all fills many of
them. A partition streams to files of at most `file_bytes`; a file appears under its name only
when it is complete, so a task that is run again replaces it by equal content.

Null texts count as empty; a null doc_id sorts first; repeated doc_ids stand side by side, null texts first, then by a
hash of the text. An empty table gives no files. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .encoder import encoder, with_end
from .scratch import folder, written

MAGIC = b"CMTOKID1"
_TRAILER = struct.Struct("<IIQQQ")  # bits, ids in a block, documents, ids, place of the footer
MANIFEST = "shard int, part int, path string, n_docs long, n_ids long, n_bytes long"


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, least significant first; eight ids fill `bits` bytes."""
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), K.U64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), bits + 8), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        value = lanes[:, lane] << K.U64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, byte + k] |= (value >> K.U64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[: (n * bits + 7) // 8]


def unpack(raw: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids first .. first + n of a packed block."""
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    at = np.arange(first, first + n, dtype=np.int64) * bits
    return ((view[at >> 3] >> (at & 7).astype(K.U64)) & K.U64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams documents' ids to one file; `close` puts the file under its name."""

    def __init__(self, path: str, bits: int, block: int = 1 << 16):
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.draft = f"{self.path}.{np.random.default_rng().integers(1 << 62):x}.draft"
        self.out = self.files.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.bits, self.block, self.at, self.n = bits, block, len(MAGIC), 0
        self.rest, self.offsets, self.docs, self.valid, self.starts = np.zeros(0, np.uint32), [], [], [], []

    def add(self, docs: np.ndarray, valid: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.docs.append(docs.astype("<i8"))
        self.valid.append(valid.astype(np.uint8))
        self.starts.append(self.n + np.cumsum(counts) - counts)
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) - len(ids) % self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.out.write(raw := pack(ids, self.bits))
        self.at += len(raw)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate([np.zeros(0, "<i8"), *self.docs])
        starts = np.append(np.concatenate([np.zeros(0, np.int64), *self.starts]), self.n).astype("<i8")
        valid = np.concatenate([np.zeros(0, np.uint8), *self.valid])
        footer = docs.tobytes() + starts.tobytes() + np.array([*self.offsets, self.at], "<i8").tobytes() + valid.tobytes()
        self.out.write(footer + _TRAILER.pack(self.bits, self.block, len(docs), self.n, self.at) + MAGIC)
        self.out.close()
        self.files.move(self.draft, self.path)
        return len(docs), self.n, self.at + len(footer) + _TRAILER.size + len(MAGIC)


class Reader:
    """Random access to a file: reads the footer, then only the blocks that are asked for."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(_TRAILER.size + len(MAGIC), size - _TRAILER.size - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        self.bits, self.block, n_docs, self.n, at = _TRAILER.unpack(tail[: _TRAILER.size])
        footer = self.file.read_at(size - _TRAILER.size - len(MAGIC) - at, at)
        n_blocks = -(-self.n // self.block)
        longs = np.frombuffer(footer, "<i8", 2 * n_docs + 2 + n_blocks)
        self.docs, self.starts, self.offsets = longs[:n_docs], longs[n_docs : 2 * n_docs + 1], longs[2 * n_docs + 1 :]
        self.valid = np.frombuffer(footer, np.uint8, n_docs, offset=8 * len(longs)).astype(bool)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids at places first .. last of the file."""
        out = [np.zeros(0, np.uint32)]
        for b in range(first // self.block, -(-last // self.block)):
            lo, hi = max(first, b * self.block) - b * self.block, min(last, (b + 1) * self.block) - b * self.block
            raw = self.file.read_at(int(self.offsets[b + 1] - self.offsets[b]), int(self.offsets[b]))
            out.append(unpack(raw, hi - lo, self.bits, lo))
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, path: str, vocabulary_file: str, vocabulary: int, end: int, *, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None, file_bytes: int = 32 << 20) -> DataFrame:
    """Encodes all texts and writes their ids below `path`; returns the manifest, one row for each file.

    `shards` range partitions by doc_id and text are written, as many as spark.sql.shuffle.partitions unless given.
    """
    spark = docs.sparkSession
    bits = bits_for(vocabulary)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, part, shard, out = encoder(vocabulary_file), None, 0, 0, []

        def name() -> str:
            return f"{path}/shard-{shard:07d}-{part:05d}.ids"

        for batch in batches:
            for s in K.slices(batch, 2):
                shard = s.column(0)[0].as_py()
                ids, counts = with_end(*enc.encode(K.texts(s.column(2))), end)
                writer = writer or Writer(name(), bits)
                column = s.column(1)
                writer.add(np.asarray(column.fill_null(0)), np.asarray(column.is_valid()), ids, counts)
                if writer.at + len(writer.rest) * bits // 8 >= file_bytes:
                    out.append((shard, part, name(), *writer.close()))
                    writer, part = None, part + 1
        if writer:
            out.append((shard, part, name(), *writer.close()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "part", "path", "n_docs", "n_ids", "n_bytes"])

    text = F.col(text_column)
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text)).alias("name"), F.monotonically_increasing_id().alias("row"))
    ordered = named.repartitionByRange(shards, "doc_id", "name", "row").sortWithinPartitions("doc_id", "name", "text")  # equal rows may be in any order
    rows = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(encode, MANIFEST)
    return written(rows, "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, ids as binary.

    `ids` holds little-endian unsigned 32-bit integers.
    """
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(path)
                first = 0
                while first < len(r.docs):
                    last = max(first + 1, int(np.searchsorted(r.starts, r.starts[first] + (1 << 20), "right")) - 1)
                    at = r.starts[first : last + 1]
                    raw = r.ids(int(at[0]), int(at[-1])).astype("<u4").tobytes()
                    cut = ((at - at[0]) * 4).tolist()
                    crc = [zlib.crc32(memoryview(raw)[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                    blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(np.array(cut, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(r.docs[first:last], pa.int64(), mask=~r.valid[first:last]), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64()), blobs], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                    first = last

    # The manifest has a row for each file, not for each document: one window over it is small.
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "base").repartition(n, "path").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: ids of all documents through the files and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(docs, folder(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50_257, end=0)
    return read(manifest).drop("ids")

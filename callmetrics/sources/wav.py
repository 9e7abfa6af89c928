"""WAV recordings as blocks of samples, read by ranges of bytes.

`spark.read.format("wav").load(folder)` (after `register`) gives the blocks of all recordings `<call_id>.wav` of a
folder. A task gets a range of bytes, or several small files: it reads a file's header, then only the blocks that begin in its range and the `OVERLAP`
samples after each, so no task and no row holds a recording. A filter on call_id goes to the source: those files alone are looked up.

PCM of 8, 16, 24 and 32 bits, 32 and 64 bit floats, and the extensible form of these; other chunks before the samples; files
above 4 GB (RF64), and streamed ones, whose header does not know their length, to their end. A file that ends early gives the whole
samples that are there. Bytes that are not such a file give one row with DECODE_ERROR, more than one channel one with CHANNEL_MISMATCH.
A recording without samples is one empty block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.signals import BLOCK, OVERLAP

SCHEMA = "call_id string, sample_rate int, start_sample long, samples array<float>, after array<float>, error_code string"
SPLIT_BYTES = 64 << 20
#: Samples that a task decodes at once, about.
PIECE = 1 << 22

#: Form codes of the header, by number of bits their numpy type.
_PCM, _FLOAT, _EXTENSIBLE, _UNKNOWN = 1, 3, 0xFFFE, 0xFFFFFFFF
_KINDS = {(_PCM, 8): "u1", (_PCM, 16): "<i2", (_PCM, 24): "i3", (_PCM, 32): "<i4", (_FLOAT, 32): "<f4", (_FLOAT, 64): "<f8"}

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Layout:
    """Where a file's samples are, and what they are."""

    rate: int
    channels: int
    kind: str
    first: int
    samples: int

    @property
    def width(self) -> int:
        return int(self.kind[-1])

    def decoded(self, raw: bytes) -> np.ndarray:
        """Samples as 32-bit floats, integers as shares of their range."""
        if self.kind == "u1":
            return (np.frombuffer(raw, "u1").astype(np.float32) - np.float32(128)) / np.float32(128)
        if self.kind == "i3":
            wide = np.zeros((len(raw) // 3, 4), np.uint8)
            wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
            return (wide.view("<i4")[:, 0] / float(1 << 31)).astype(np.float32)
        x = np.frombuffer(raw, self.kind)
        return x.astype(np.float32) if self.kind[1] == "f" else (x / float(1 << (8 * self.width - 1))).astype(np.float32)


def layout(read: Read, size: int) -> Layout | None:
    """The layout of a file of `size` bytes; none if it is not a file of a known kind. `read` takes a place and a number of bytes."""
    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    number = lambda raw, at, n: int.from_bytes(raw[at : at + n], "little")
    streamed = number(head, 4, 4) in (0, _UNKNOWN)
    at, form, data, long = 12, None, None, None
    while at + 8 <= size and (form is None or data is None):
        chunk = read(at, 8)
        name, length = chunk[:4], number(chunk, 4, 4)
        body = at + 8
        if name == b"ds64":
            long = number(read(body, 16), 8, 8)
        elif name == b"fmt ":
            raw = read(body, min(length, 40))
            if len(raw) < 16:
                return None
            form = (number(raw, 24, 2) if number(raw, 0, 2) == _EXTENSIBLE and len(raw) >= 26 else number(raw, 0, 2), number(raw, 14, 2), number(raw, 2, 2), number(raw, 4, 4))
        elif name == b"data":
            if length == _UNKNOWN:
                length = long if long is not None else size - body
            elif length == 0 and streamed:
                length = size - body
            data = (body, min(length, max(0, size - body)))
        at = body + length + length % 2
    if form is None or data is None or form[:2] not in _KINDS or not form[2] or not form[3] or form[3] > 0x7FFFFFFF:
        return None
    kind = _KINDS[form[:2]]
    return Layout(form[3], form[2], kind, data[0], data[1] // (int(kind[-1]) * form[2]))


def _batch(call: str, rate: int | None, starts: list[int], samples: list[np.ndarray], after: list[np.ndarray], error: str | None) -> pa.RecordBatch:
    lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.float32), *parts]), pa.float32()))
    n = len(starts)
    columns = [pa.array([call] * n, pa.string()), pa.array([rate] * n, pa.int32()), pa.array(starts, pa.int64()), lists(samples), lists(after), pa.array([error] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def blocks_between(call: str, read: Read, size: int, lo: int, hi: int, block: int = BLOCK, claimed: int | None = None) -> Iterator[pa.RecordBatch]:
    """The blocks that begin at bytes lo to hi of a file. What the whole file has one row for, an error or no samples, is its first range's."""
    found, nothing = layout(read, size), np.zeros(0, np.float32)
    error = "DECODE_ERROR" if found is None else "SAMPLE_RATE_MISMATCH" if claimed is not None and found.rate != claimed else "CHANNEL_MISMATCH" if found.channels != 1 else None
    if error or not found.samples:
        if lo == 0:
            rate = claimed if claimed is not None else found.rate if found else None
            yield _batch(call, rate, [0], [nothing], [nothing], error)
        return
    bytes_each = block * found.width
    until = lambda at: max(0, -(-(at - found.first) // bytes_each))  # noqa: E731  blocks that begin before a byte
    b, last = until(lo), min(until(hi), -(-found.samples // block))
    while b < last:
        n = min(last - b, max(1, PIECE // block))
        start, end = b * block, min((b + n) * block, found.samples)
        x = found.decoded(read(found.first + start * found.width, (min(end + OVERLAP, found.samples) - start) * found.width))
        cuts = list(range(0, end - start, block))
        yield _batch(call, found.rate, [start + c for c in cuts], [x[c : min(c + block, end - start)] for c in cuts], [x[c + block : c + block + OVERLAP] for c in cuts], None)
        b += n


@dataclass
class Ranges(InputPartition):
    """Ranges of bytes of files: (path, size, lo, hi) each."""

    files: list[tuple[str, int, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["path"]
        self.block = int(options.get("block", BLOCK))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.task = int(options.get("taskbytes", self.split))
        self.calls: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is None or tuple(f.attribute) != ("call_id",):
                yield f
            else:
                self.calls = named if self.calls is None else self.calls & named

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.base)
        if self.calls is not None:  # the files of these calls, without a listing
            infos = files.get_file_info([f"{base}/{c}.wav" for c in sorted(self.calls)])
        else:
            infos = files.get_file_info(fs.FileSelector(base))
        out, some, held = [], [], 0
        for i in infos:
            if i.type != fs.FileType.File or not i.path.endswith(".wav"):
                continue
            for lo in range(0, max(1, i.size), self.split):
                hi = min(lo + self.split, max(1, i.size))
                if some and held + hi - lo > self.task:
                    out.append(Ranges(some))
                    some, held = [], 0
                some.append((i.path, i.size, lo, hi))
                held += hi - lo
        return [*out, *([Ranges(some)] if some or not out else [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.base)
        for path, size, lo, hi in partition.files:
            with files.open_input_file(path) as f:
                yield from blocks_between(path.rpartition("/")[2].removesuffix(".wav"), lambda at, n, f=f: f.read_at(n, at), size, lo, hi, self.block)


class WavSource(DataSource):
    """Options: path (a URI), block (samples), splitBytes (of a range), taskBytes (of the ranges that a task reads, splitBytes unless given)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes format `wav` known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)


def wav_files(spark: SparkSession, folder: str, *, block: int = BLOCK, split_bytes: int = SPLIT_BYTES, task_bytes: int | None = None) -> DataFrame:
    """Blocks of the recordings of a folder, for the analyzers; rows with an error_code have no samples."""
    register(spark)
    return spark.read.format("wav").option("block", block).option("splitBytes", split_bytes).option("taskBytes", task_bytes or split_bytes).load(folder)


def against(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """Blocks with SAMPLE_RATE_MISMATCH where the reference (call_id, sample_rate) claims another rate: one row a call, without samples. Calls without a reference stay as they are."""
    claimed = references.select("call_id", F.col("sample_rate").alias("_claimed"))
    joined = blocks.join(claimed, "call_id", "left")
    wrong = F.coalesce(F.col("_claimed") != F.col("sample_rate"), F.lit(False)) & F.col("error_code").isNull()
    none = F.array().cast("array<float>")
    changed = {"error_code": F.when(wrong, "SAMPLE_RATE_MISMATCH").otherwise(F.col("error_code")), "sample_rate": F.coalesce("_claimed", "sample_rate"), "samples": F.when(wrong, none).otherwise(F.col("samples")), "after": F.when(wrong, none).otherwise(F.col("after"))}
    return joined.filter(~wrong | (F.col("start_sample") == 0)).withColumns(changed).select(*blocks.columns)


def encoded(samples: np.ndarray, rate: int, bits: int = 16, *, floats: bool = False) -> bytes:
    """A WAV file of one channel. Integers are the floor of the share of their range, within it."""
    x = np.asarray(samples, np.float64)
    if floats:
        body = x.astype(f"<f{bits // 8}").tobytes()
    else:
        whole = np.clip(np.floor(x * (1 << (bits - 1))), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype("<i8")
        body = (whole + 128 if bits == 8 else whole).astype("<i8").view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()
    form = np.array([_FLOAT if floats else _PCM, 1], "<u2").tobytes() + np.array([rate, rate * bits // 8], "<u4").tobytes() + np.array([bits // 8, bits], "<u2").tobytes()
    chunk = lambda name, raw: name + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) % 2)
    inside = b"WAVE" + chunk(b"fmt ", form) + chunk(b"data", body)
    return b"RIFF" + len(inside).to_bytes(4, "little") + inside


def write_wav(signals: DataFrame, folder: str) -> DataFrame:
    """Writes each recording (call_id, sample_rate, samples, bits, floats) as `<call_id>.wav` below a folder; call_id and bytes of each. A file has its content at once, so a task that runs again changes nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base)
        for batch in batches:
            sizes = []
            for r in range(batch.num_rows):
                call, rate, bits, floats = (batch.column(i)[r].as_py() for i in (0, 1, 3, 4))
                raw = encoded(np.asarray(batch.column(2)[r].values), rate, bits, floats=floats)
                draft = f"{base}/{call}.{np.random.default_rng().integers(1 << 62):x}.draft"
                with files.open_output_stream(draft) as out:
                    out.write(raw)
                files.move(draft, f"{base}/{call}.wav")
                sizes.append((call, len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sizes], pa.string()), pa.array([n for _, n in sizes], pa.int64())], names=["call_id", "size"])

    return signals.select(F.col("call_id").cast("string"), F.col("sample_rate").cast("int"), F.col("samples").cast("array<float>"), F.col("bits").cast("int"), F.col("floats").cast("boolean")).mapInArrow(rows, "call_id string, size long")

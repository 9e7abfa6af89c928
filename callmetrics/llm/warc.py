"""Operator 11, WARC archives: written with revisits, read by boundary-chain verification.

Writing: each page is a `response` record whose block is an HTTP message with the html as its payload, or, if an equal
payload of at least `least` bytes has a record already, a `revisit` that names it and holds the HTTP header alone. The
group's response is the page with the smallest id; of pages that share that id, the first row of the first file (by hash
of its name). Pages without an id come last. Only digests and ids are shuffled to find groups; the pages
themselves are joined with the groups of two and more, which are broadcast below `BROADCAST_ROWS` and else shuffled.

Reading: a file is cut into ranges of bytes. A payload may hold what looks like a record, so that a task that starts
inside a file cannot tell records from their imitations. Therefore each task looks for everything in its range that reads
like a record's header (a candidate) and follows the lengths within its range: each candidate gets the place where its
chain leaves the range. Places that some chain leads to are a few for each range; pointers between these are doubled
round by round from the start of each file, and only what is reached is the start of records. A second task for each
reached place reads the records from there to the range's end.

A null or empty html is an empty payload, below `least`. A null url is an empty target. Ids may repeat or be null. A
chain that breaks off (a cut or damaged file) gives the records before the break, and `verified` tells of it. An empty
table gives no files. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import folder, written

#: Groups of equal payloads that are broadcast at most: 70 bytes each, so some 3 MB.
BROADCAST_ROWS = 40_000
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
MANIFEST = "path string, n_records long, size long"
RECORDS = "path string, offset long, type string, record_id string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string, intact boolean"
_PROFILE = b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!#-'*+\-.^-z|~0-9A-Z]+):[ \t]*(.*?)[ \t]*", re.DOTALL)


def _placed(pages: DataFrame, id_column: str, url_column: str, text_column: str) -> DataFrame:
    """Pages with the place of their row, which no other row has: a hash of the file's name and the row's number there. What isn't read from files is written first."""
    try:
        pages.select("_metadata.row_index")
    except AnalysisException:
        pages = written(pages.select(id_column, url_column, text_column), "warc-pages")
    payload = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("payload"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))


def _uri(url: str) -> bytes:
    """A url for a header line: spaces and control characters are written as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode()


def _name(page: int | None, file: int, row: int) -> bytes:
    """A record's id, from which the page's id can be read."""
    return b"<urn:page:%s:%016x:%x>" % (b"" if page is None else b"%d" % page, file & ((1 << 64) - 1), row)


def _record(page: dict, date: bytes) -> bytes:
    first, own = page["first"], _name(page["id"], page["file"], page["row"])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page["payload"])
    again = first is not None and (first["file"], first["row"]) != (page["file"], page["row"])
    kind = b"revisit\r\n" + _PROFILE + b"WARC-Refers-To: %s" % _name(first["id"], first["file"], first["row"]) if again else b"response"
    block = http if again else http + page["payload"]
    return (
        b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: %s\r\nWARC-Date: %s\r\nWARC-Target-URI: %s\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
        % (kind, own, date, _uri(page["url"]), page["digest"].hex().encode(), len(block), block)
    )


def write(pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes a record for each page to archives below `path`; returns the manifest, a row for each file.

    A file has a name of its own, so a task that is run again cannot change a file that the manifest names.
    """
    rows = _placed(pages, id_column, url_column, text_column)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    groups = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1").select("digest", "first"), "warc-groups")
    if groups.limit(broadcast_rows + 1).count() <= broadcast_rows:
        groups = F.broadcast(groups)
    stamp = date.encode()

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base)
        out, done, n, size, name = None, [], 0, 0, ""
        for page in (page for batch in batches for s in K.slices(batch, 2) for page in s.to_pylist()):
            if out is None:
                name, n = f"{uuid.uuid4().hex}.warc", 0
                out = files.open_output_stream(f"{base}/{name}")
                about = b"software: callmetrics\r\nformat: WARC File Format 1.1\r\n"
                out.write(head := b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid4()).encode(), stamp, len(about), about))
                size = len(head)
            out.write(raw := _record(page, stamp))
            n, size = n + 1, size + len(raw)
            if size >= file_bytes:
                out.close()
                done.append((f"{path}/{name}", n, size))
                out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", n, size))
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "n_records", "size"])

    return written(rows.join(groups, "digest", "left").select("id", "url", "payload", "digest", "file", "row", "first").mapInArrow(archive, MANIFEST), "warc-manifest")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """A manifest (path, size) of archives that others wrote; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


class _Window:
    """A file's bytes around a place, read in pieces as they are asked for."""

    def __init__(self, path: str, piece: int = 1 << 20):
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(path)
        self.file, self.piece = files.open_input_file(name), piece
        self.size, self.at, self.data = self.file.size(), 0, b""

    def load(self, at: int, end: int) -> None:
        self.at, self.data = at, self.file.read_at(max(0, min(end, self.size) - at), at)

    def line(self, at: int) -> tuple[bytes, int] | None:
        """The line at a place, and the place after it; none if the file ends before a line break."""
        if not self.at <= at < self.at + len(self.data):
            self.load(at, at + self.piece)
        while (end := self.data.find(b"\r\n", at - self.at)) < 0:
            got = self.at + len(self.data)
            if got >= self.size:
                return None
            self.data += self.file.read_at(min(self.size - got, max(self.piece, len(self.data))), got)
        return self.data[at - self.at : end], self.at + end + 2

    def slice(self, at: int, end: int) -> bytes:
        if self.at <= at and end <= self.at + len(self.data):
            return self.data[at - self.at : end - self.at]
        return self.file.read_at(end - at, at)


def _header(w: _Window, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields of the record's header at a place, where its block starts, and where the next record would start; none if there is no whole record."""
    first = w.line(at)
    if first is None or not _MAGIC.fullmatch(first[0] + b"\r\n"):
        return None
    fields: dict[bytes, bytes] = {}
    at, last = first[1], b""
    while (got := w.line(at)) is not None:
        text, at = got
        if not text:
            length = fields.get(b"content-length", b"")
            if not re.fullmatch(rb"\d{1,18}", length) or at + int(length) + 4 > w.size:
                return None
            return fields, at, at + int(length) + 4
        if text[:1] in b" \t" and last:
            fields[last] += b" " + text.strip()
        elif m := _FIELD.fullmatch(text):
            last = m[1].lower()
            fields[last] = m[2]
        else:
            return None
    return None


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Ranges of the files: path, lo, hi."""
    lo = F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)"))
    return files.filter("size > 0").select("path", lo.alias("lo"), "size").select("path", "lo", F.least(F.col("lo") + split_bytes, "size").alias("hi"))


def candidates(ranges: DataFrame) -> DataFrame:
    """Everything that reads like a record (path, at), and where its chain leaves the range (leaves), -1 if it breaks off there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, leaves = _Window(r["path"]), {}
                w.load(r["lo"], r["hi"] + 16)
                hits = [r["lo"] + m.start() for m in _MAGIC.finditer(w.data) if r["lo"] + m.start() < r["hi"]]
                for at in reversed(hits):
                    if (found := _header(w, at)) is not None:
                        leaves[at] = found[2] if found[2] >= r["hi"] else leaves.get(found[2], -1)
                    if w.at > r["lo"]:  # a header far beyond the range was looked at
                        w.load(r["lo"], r["hi"] + 16)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(leaves), pa.string()), pa.array(list(leaves), pa.int64()), pa.array(list(leaves.values()), pa.int64())], names=["path", "at", "leaves"])

    return _dealt(ranges, "lo").mapInArrow(scan, "path string, at long, leaves long")


def _dealt(rows: DataFrame, at: str) -> DataFrame:
    """Rows that stand for work on files, dealt over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", at)


def reached(files: DataFrame, found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Places of records that a chain from the file's start enters a range by: path, at, leaves. By doubling pointers, in as many rounds as the ranges of the longest file have binary digits."""
    found = written(found, "warc-candidates")
    entries = found.select("path", F.col("leaves").alias("at")).filter("at > 0").union(files.select("path", F.lit(0).cast("long"))).distinct()
    jumps = written(found.join(entries, ["path", "at"], "left_semi"), "warc-jumps")
    there = jumps.filter("at = 0").select("path", "at")
    longest = files.agg(F.max(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    hop = jumps
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        step = there.join(hop, ["path", "at"]).select("path", F.col("leaves").alias("at"))
        there = written(there.union(step).distinct(), "warc-reached")
        ahead = hop.select("path", F.col("at").alias("leaves"), F.col("leaves").alias("to"))
        hop = written(hop.join(ahead, ["path", "leaves"]).select("path", "at", F.col("to").alias("leaves")), "warc-hops")
    return jumps.join(there, ["path", "at"], "left_semi")  # also drops what leads behind the end or to no record


def verified(files: DataFrame, *, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, and `complete`: whether the chain of records runs from the file's start to its end."""
    ends = reached(files, candidates(splits(files, split_bytes)), split_bytes).groupBy("path").agg(F.max("leaves").alias("end"))
    return files.join(ends, "path", "left").select("path", (F.coalesce("end", F.lit(0)) == F.col("size")).alias("complete"))


def read(files: DataFrame, *, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives (path, size): their place, type, ids, target and payload, with its size and digest.

    Of a response both are those of the payload as it is read, and `intact` says whether the digest is the one that the header
    names; a revisit has no payload, so they are as its headers say, if they do. Other records' payload is their block.
    """
    entries = reached(files, candidates(splits(files, split_bytes)), split_bytes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w, rows, held = _Window(path), [], 0
                end = (at // split_bytes + 1) * split_bytes
                while at < min(end, w.size) and (found := _header(w, at)) is not None:
                    row = (path, at, *_content(w, *found))
                    rows.append(row if payloads else row[:-1])
                    held, at = held + len(row[-1] or b""), found[2]
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield _batch(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, payloads)

    return _dealt(entries.select("path", "at"), "at").mapInArrow(parse, RECORDS + ", payload binary" * payloads)


def _content(w: _Window, fields: dict[bytes, bytes], start: int, after: int) -> tuple:
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    kind, named = text(b"warc-type"), (text(b"warc-payload-digest") or "").lower()
    named = named.removeprefix("sha256:") if named.startswith("sha256:") else None
    block = w.slice(start, after - 4)
    head, blank, body = block.partition(b"\r\n\r\n") if fields.get(b"content-type", b"").lower().startswith(b"application/http") else (b"", b"", block)
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})\s*$", head)
        return kind, text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"), int(length[1]) if length else None, named, None, None
    digest = hashlib.sha256(body).hexdigest()
    return kind, text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"), len(body), digest, None if named is None else named == digest, body


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.bool_()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def page_of(record_id: str) -> F.Column:
    """The page's id in a record id that `write` gave; null if the page had none."""
    return F.nullif(F.split_part(F.col(record_id), F.lit(":"), F.lit(3)), F.lit("")).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all pages through archives and back."""
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder(spark, "warc"))
    records = read(files, payloads=False).filter("type IN ('response', 'revisit')")
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to_id").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), n AS (
  SELECT *, row_number() OVER w AS i, first_value(page_id) OVER w AS first_id
  FROM p WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND i > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND i > 1 THEN first_id END AS refers_to
FROM n
"""

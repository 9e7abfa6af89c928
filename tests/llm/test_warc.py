"""Operator 11."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from callmetrics.llm import warc

from ..conftest import same_as_sql

SCHEMA = "page_id long, url string, html string, digest string, file string, row int, first string"
FORGED = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666:0:0>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"


def pages():
    """Nulls, repeats, copies, imitations of records, of headers and of ends."""
    long = "<p>" + "a text of some length. " * 9 + "</p>"
    fake = FORGED.format(5, "12345")
    texts = [
        None, "", "short", "short", long, long, long.upper(), long, fake, "\r\n\r\n" + fake * 3, fake[:40], FORGED.format(10**6, "far"), FORGED.format(300, "over the end"), "WARC/1.0\r\n" * 50, "WARC/1.1\r\nno field\r\n\r\n",
        "é" * 50, "é" * 50, "x" * 99, "x" * 99, "x" * 100, "x" * 100, "y" * 5000, "\r\n\r\n" * 40, FORGED.format(0, ""),
    ]
    rows = [(i, f"https://h{i}.example/\n a", t) for i, t in enumerate(texts)] + [(4, None, long), (None, "u", long), (None, None, None), (None, "v", "only without an id, and long enough " * 5), (-3, "w", long)]
    return [(*r, "clash", "clash", 1, "clash") for r in rows]


def expected(rows):
    groups = {}
    for page, _, text, *_ in rows:
        groups.setdefault((text or "").encode(), []).append(page)
    out = []
    for raw, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, page in enumerate(ids):
            again = len(raw) >= 100 and n > 0
            out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def answers(records):
    found = records.filter("type IN ('response', 'revisit')").select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "type", warc.page_of("refers_to_id").alias("r"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def sequential(raw):
    """Offsets of the records, by reading from the start."""
    out, at = [], 0
    while at < len(raw):
        head = raw[at:].split(b"\r\n\r\n", 1)[0]
        length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        out.append(at)
        at += len(head) + 4 + length + 4
    return out


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_pages_through_archives_and_back(spark, tmp_path, broadcast_rows):
    rows = pages()
    files = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"file://{tmp_path}/w", broadcast_rows=broadcast_rows)
    for split_bytes in (190, 1 << 20):
        records = warc.read(files, split_bytes=split_bytes)
        assert answers(records) == expected(rows)
        assert records.filter("type = 'response' AND NOT intact").count() == 0
        at = sorted((r["path"], r["offset"]) for r in records.collect())
        want = sorted((f["path"], o) for f in files.collect() for o in sequential(open(f["path"].removeprefix("file://"), "rb").read()))
        assert at == want
    texts = {r["payload"].decode() for r in warc.read(files).filter("type = 'response'").collect()}
    assert texts == {t or "" for _, _, t, *_ in rows}


def test_small_files_and_whole_rows(spark, tmp_path):
    rows = pages()
    files = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), f"file://{tmp_path}/w", file_bytes=900)
    assert files.count() > 5
    assert answers(warc.read(files, split_bytes=400)) == expected(rows)
    assert files.agg(F.sum("n_records")).first()[0] == len(rows)


def test_damaged_and_foreign_archives(spark, tmp_path):
    """A cut file gives the records before the cut; one that does not start with a record gives none."""
    files = warc.write(spark.createDataFrame(pages(), SCHEMA).coalesce(1), f"file://{tmp_path}/w")
    path = files.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    at = sequential(raw)
    os.makedirs(tmp_path / "f")
    for name, data in {"whole": raw, "cut": raw[: at[9] + 30], "noise": b"noise" + raw, "lf": raw.replace(b"WARC/1.1\r\nWARC-Type: warcinfo", b"WARC/1.1\nWARC-Type: warcinfo")}.items():
        (tmp_path / "f" / f"{name}.warc").write_bytes(data)
    found = warc.archives(spark, f"file://{tmp_path}/f")
    counts = {r["path"].rsplit("/", 1)[1]: r["count"] for r in warc.read(found, split_bytes=200).groupBy("path").count().collect()}
    assert counts == {"whole.warc": len(at), "cut.warc": 9}
    whole = {r["path"].rsplit("/", 1)[1]: r["complete"] for r in warc.verified(found, split_bytes=200).collect()}
    assert whole == {"whole.warc": True, "cut.warc": False, "noise.warc": False, "lf.warc": False}


def test_no_pages(spark, tmp_path):
    files = warc.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert files.count() == 0 and warc.read(files).count() == 0


def test_sql(spark):
    same_as_sql(spark, warc.query, warc.ORACLE_SQL)

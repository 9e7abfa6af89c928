"""WAV recordings by ranges of bytes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callmetrics.plans import recordings as P
from callmetrics.sources import records as R
from callmetrics.sources import wav as W

from .conftest import same_as_sql


def whole(samples, bits, floats):
    """What a file must decode to, sample by sample."""
    if floats:
        return np.asarray(samples, f"<f{bits // 8}").astype(np.float32)
    top = 1 << (bits - 1)
    return np.array([min(max(int(np.floor(float(x) * top)), -top), top - 1) / top for x in samples], np.float32)


def chunk(name, raw):
    return name + len(raw).to_bytes(4, "little") + raw + b"\0" * (len(raw) % 2)


def form(bits=16, code=1, channels=1, rate=8000):
    return np.array([code, channels], "<u2").tobytes() + np.array([rate, rate * bits // 8], "<u4").tobytes() + np.array([channels * bits // 8, bits], "<u2").tobytes()


def riff(*chunks, magic=b"RIFF", size=None):
    body = b"WAVE" + b"".join(chunks)
    return magic + (len(body) if size is None else size).to_bytes(4, "little") + body


PCM = np.arange(-3, 7, dtype="<i2").tobytes()


def joined(batches, after):
    """Samples of consecutive blocks, each with the right samples after it."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["start_sample"])
    x = [v for r in rows for v in r["samples"]]
    for r in rows:
        end = r["start_sample"] + len(r["samples"])
        assert r["after"] == x[end : end + after]
    assert [r["start_sample"] for r in rows] == [sum(len(q["samples"]) for q in rows[:i]) for i in range(len(rows))]
    return x


@pytest.mark.parametrize("bits,floats", [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
def test_cuts_anywhere(bits, floats, monkeypatch):
    monkeypatch.setattr(W, "OVERLAP", 5)
    samples = np.random.default_rng(bits).uniform(-1.1, 1.1, 83)
    raw = W.encoded(samples, 8000, bits, floats=floats)
    want = whole(samples, bits, floats).tolist()
    for step in (1, 7, 16, 50, 131, len(raw)):
        for block in (1, 8, 83, 200):
            cuts = [*range(0, len(raw), step), len(raw)]
            got = [b for lo, hi in zip(cuts, cuts[1:], strict=False) for b in W.blocks_between("c", lambda at, n: raw[at : at + n], len(raw), lo, hi, block)]
            assert joined(got, 5) == want


def one(raw, claimed=None):
    rows = [r for b in W.blocks_between("c", lambda at, n: raw[at : at + n], len(raw), 0, max(1, len(raw)), 64, claimed) for r in b.to_pylist()]
    assert len(rows) == 1
    return rows[0]["error_code"], [round(x * 32768) for x in rows[0]["samples"]]


def test_kinds_of_files():
    data, whole = chunk(b"data", PCM), list(range(-3, 7))
    wide = form(code=0xFFFE) + (22).to_bytes(2, "little") + bytes([16, 0, 0, 0, 0, 0]) + (1).to_bytes(2, "little") + bytes(14)
    ds64 = chunk(b"ds64", (0).to_bytes(8, "little") + len(PCM).to_bytes(8, "little") + bytes(12))
    good = {
        "plain": riff(chunk(b"fmt ", form()), data), "lists": riff(chunk(b"LIST", b"odd"), chunk(b"fmt ", form()), chunk(b"fact", bytes(4)), data, chunk(b"LIST", b"data....")),
        "extensible": riff(chunk(b"fmt ", wide), data), "streamed": riff(chunk(b"fmt ", form()), b"data\xff\xff\xff\xff" + PCM, size=0xFFFFFFFF), "no length": riff(chunk(b"fmt ", form()), b"data\0\0\0\0" + PCM, size=0),
        "long": riff(ds64, chunk(b"fmt ", form()), b"data\xff\xff\xff\xff" + PCM + b"more bytes", magic=b"RF64", size=0xFFFFFFFF), "samples first": riff(data, chunk(b"fmt ", form())),
    }
    for name, raw in good.items():
        assert one(raw) == (None, whole), name
        assert one(raw, 8000) == (None, whole) and one(raw, 16000) == ("SAMPLE_RATE_MISMATCH", [])
    assert one(riff(chunk(b"fmt ", form()), chunk(b"data", PCM))[:-3]) == (None, whole[:-2])  # ends early
    assert one(riff(chunk(b"fmt ", form()), chunk(b"data", b""))) == (None, [])
    assert one(riff(chunk(b"fmt ", form(channels=2)), data)) == ("CHANNEL_MISMATCH", [])
    plain = good["plain"]
    for cut in range(44 - 8):
        assert one(plain[:cut]) == ("DECODE_ERROR", []), cut
    for raw in (b"", b"RIFF", riff(chunk(b"fmt ", form()[:7]), data), riff(data), riff(chunk(b"fmt ", form())), riff(chunk(b"fmt ", form(code=2)), data), riff(chunk(b"fmt ", form(bits=12)), data), riff(chunk(b"fmt ", form(rate=0)), data), b"OggS" + plain):
        assert one(raw) == ("DECODE_ERROR", [])


def test_source(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    signals = {f"c{i}": rng.uniform(-1, 1, n) for i, n in enumerate((0, 1, 999, 1000, 1001, 5000))}
    rows = [(c, 8000, [float(v) for v in x], 16, False) for c, x in signals.items()]
    frame = spark.createDataFrame(rows, "call_id string, sample_rate int, samples array<float>, bits int, floats boolean")
    folder = f"file://{tmp_path}/w"
    assert {r["call_id"]: r["size"] for r in W.write_wav(frame, folder).collect()} == {c: 44 + 2 * len(x) for c, x in signals.items()}
    (tmp_path / "w" / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt \x10")
    (tmp_path / "w" / "other.txt").write_text("not a recording")
    for split in (300, 1 << 20):
        blocks = W.wav_files(spark, folder, block=400, split_bytes=split)
        got = {}
        for r in blocks.orderBy("call_id", "start_sample").collect():
            got.setdefault(r["call_id"], []).append(r)
        assert {c: r[0]["error_code"] for c, r in got.items() if r[0]["error_code"]} == {"bad": "DECODE_ERROR"}
        for c, x in signals.items():
            assert [v for r in got[c] for v in r["samples"]] == whole(x.astype(np.float32), 16, False).tolist()
    assert blocks.rdd.getNumPartitions() == 1 and W.wav_files(spark, folder, split_bytes=1000).rdd.getNumPartitions() > 10

    asked = W.wav_files(spark, folder, split_bytes=300).filter("call_id = 'c2'")
    assert asked.count() == 1 and asked.rdd.getNumPartitions() == 7  # 2,042 bytes of that file alone
    assert W.wav_files(spark, folder).filter(F.col("call_id").isin("c5", "c1", "none")).select("call_id").distinct().count() == 2
    claims = spark.createDataFrame([("c4", 16000), ("c3", 8000)], "call_id string, sample_rate int")
    checked = W.against(W.wav_files(spark, folder, block=400), claims)
    assert {(r["call_id"], r["error_code"]) for r in checked.filter("call_id IN ('c2', 'c3', 'c4')").collect()} == {("c2", None), ("c3", None), ("c4", "SAMPLE_RATE_MISMATCH")}
    assert checked.filter("call_id = 'c4'").count() == 1


def test_bytes_in_rows(spark):
    """No bytes end a job, and a null claim claims nothing."""
    plain = riff(chunk(b"fmt ", form()), chunk(b"data", PCM))
    rows = [("ok", plain, 8000), ("free", plain, None), ("null", None, 8000), ("short", riff(chunk(b"fmt ", b"\1\0")), 8000), ("empty", b"", None)]
    got = {r["call_id"]: r["error_code"] for r in R.wav_blocks(spark.createDataFrame(rows, "call_id string, content binary, sample_rate int")).collect()}
    assert got == {"ok": None, "free": None, "null": "DECODE_ERROR", "short": "DECODE_ERROR", "empty": "DECODE_ERROR"}


def test_sql(spark):
    same_as_sql(spark, P.wav_samples, P.SQL["wav_samples"])

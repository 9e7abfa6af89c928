"""Operators 1, 2, 4, 8."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callmetrics.llm import packing, sharding, token_counts, token_files
from callmetrics.llm.scratch import folder

from ..conftest import SMALL
from .fixtures import awkward, crc_ids, words

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def encoded(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=40), st.data())
def test_packed_bits_round_trip(bits, values, data):
    x = np.array([v & ((1 << bits) - 1) for v in values], np.uint32)
    raw = token_files.pack(x, bits)
    assert len(raw) == (len(x) * bits + 7) // 8
    first = data.draw(st.integers(0, len(x)))
    assert token_files.unpack(raw, len(x) - first, bits, first).tolist() == x[first:].tolist()


def test_bits_of_vocabularies():
    assert [token_files.bits_for(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_files_hold_all_ids_in_order(spark, odd, tmp_path):
    manifest = token_files.write(odd, folder(spark, "t"), BYTE, 50_257, 0, shards=3, file_bytes=3000)
    assert manifest.count() == 3
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in token_files.read(manifest).collect()))
    rows = sorted(((r[0], r[1]) for r in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (at, doc, n, crc, raw), (want, text) in zip(got, rows, strict=True):
        ids = encoded(BYTE, text, 0)
        assert (at, doc, n, crc) == (start, want, len(ids), crc_ids(ids)) and np.frombuffer(raw, "<u4").tolist() == ids
        start += n


def test_random_access(spark, odd):
    path = token_files.write(odd, folder(spark, "t"), BYTE, 50_257, 0, shards=1).first()["path"]
    r = token_files.Reader(path)
    whole = r.ids(0, r.n)
    assert all((r.ids(a, b) == whole[a:b]).all() for a, b in ((0, 1), (5, 5), (17, 900), (r.n - 3, r.n)))
    with pytest.raises(ValueError):
        token_files.Writer(folder(spark, "w"), 3).add(np.array([1]), np.array([True]), np.array([8], np.uint32), np.array([1]))


def test_files_of_nothing(none, spark):
    assert token_files.read(token_files.write(none, folder(spark, "t"), BYTE, 50_257, 0)).count() == 0


def pieces_are_whole(rows, docs, window):
    """Each document's ids once and in order, sequences without gaps; returns sequences' lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (_, n), spans in by_doc.items():
        spans = sorted(spans)
        copies = sum(a == 0 for a, _ in spans)
        assert sum(k for _, k in spans) == n * copies
    sizes = []
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("window", [16, 64, 4096])
@pytest.mark.parametrize("few", [0, 1000])
def test_packing(odd, window, few):
    ids = packing.tokens(odd, WORD, 2, window)
    rows = packing.pack(ids, window, with_ids=True, broadcast_rows=few).collect()
    sizes = pieces_are_whole(rows, awkward(), window)
    assert all(n == window or n & (n - 1) == 0 for n in sizes)  # no padding
    want = sorted(tuple(encoded(WORD, r[1], 2)) for r in awkward())
    assert sum(len(r["ids"]) // 4 for r in rows) == sum(map(len, want))
    crc = {}
    for r in rows:
        got = np.frombuffer(bytes(r["ids"]), "<u4")
        assert r["ids_crc32"] == crc_ids(got) and len(got) == r["length"]
        crc.setdefault(r["doc_id"], []).append((r["start"], got.tolist()))
    by_id = {r[0]: encoded(WORD, r[1], 2) for r in awkward() if r[0] not in (6, None)}
    for doc, ids in by_id.items():
        assert sum((x for _, x in sorted(crc[doc])), []) == ids


def test_packing_nothing(none):
    assert packing.pack(packing.tokens(none, WORD, 2, 64), 64).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 31), st.integers(1, 4)), max_size=7), st.integers(1, 32))
def test_closest_multiset_is_best(items, target):
    counts = np.zeros(33, np.int64)
    for length, n in items:
        counts[length] += n
    sums = {0}
    for length in range(1, 33):
        sums = {s + k * length for s in sums for k in range(int(counts[length]) + 1)}
    chosen = packing.closest(target, counts)
    assert all(n <= counts[length] for length, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= target)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60))
def test_patterns_use_every_length_once(lengths):
    counts = np.bincount(lengths, minlength=64)
    used = np.zeros(64, np.int64)
    for chosen, times in packing.patterns(counts, 64):
        assert sum(k * n for k, n in chosen.items()) <= 64
        for length, n in chosen.items():
            used[length] += n * times
    assert (used == counts).all()


def test_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    t = sharding.table(names, 1009)
    assert set(np.bincount(t, minlength=10)) <= {100, 101}
    fewer = sharding.table(names[:-1], 1009)
    assert (t != fewer)[t != 9].mean() < 0.1  # few slots change hands
    # The filling by its definition.
    import hashlib

    order = []
    for name in names:
        d = hashlib.blake2b(name.encode(), digest_size=16).digest()
        a, s = int.from_bytes(d[:8], "little") % 1009, int.from_bytes(d[8:], "little") % 1008 + 1
        order.append([(a + k * s) % 1009 for k in range(1009)])
    want = {}
    while len(want) < 1009:
        for i in range(10):
            if len(want) < 1009:
                want[next(s for s in order[i] if s not in want)] = i
    assert [want[s] for s in range(1009)] == t.tolist()
    with pytest.raises(ValueError):
        sharding.table(["a", "a"])


def test_assignment(odd, none):
    rows = sharding.assign(odd, ["a", "b", "c"], size=101).collect()
    assert len(rows) == len(awkward()) and all(r["shard"] in "abc" and 0 <= r["slot"] < 101 for r in rows)
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r[0] for r in awkward()})
    assert sharding.assign(none, ["a"]).count() == 0


def test_query_equals_the_table(spark):
    names = [f"shard-{i:05d}" for i in range(256)]
    owner = sharding.table(names)
    rows = sharding.query(spark, SMALL).collect()
    assert rows and all(r["shard"] == names[owner[r["slot"]]] for r in rows)
    want = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "pmod(xxhash64(doc_id), 65537) AS slot").collect()
    assert sorted((r["doc_id"], r["slot"]) for r in rows) == sorted((r["doc_id"], r["slot"]) for r in want)


def test_table_by_turns():
    """The table against a plain version with whole permutations; a size that is no prime is refused."""
    import hashlib

    names, size = [f"s{i}" for i in range(7)], 101
    orders = []
    for name in names:
        d = hashlib.blake2b(name.encode(), digest_size=16).digest()
        a, b = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:], "little") % (size - 1) + 1
        orders.append([(a + j * b) % size for j in range(size)])
        assert len(set(orders[-1])) == size
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = i
    assert [owner[i] for i in range(size)] == sharding.table(names, size).tolist()
    for bad in (1000, 1, 65_535):
        with pytest.raises(ValueError):
            sharding.table(["a", "b"], bad)


def test_shards_are_written(spark, odd, tmp_path):
    sharding.write(odd, f"{tmp_path}/out", ["a", "b"], size=101)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(awkward())


def plain_segment(word, pieces):
    """The recurrence with every piece tried at every place."""
    longest, best, count = max(map(len, pieces.score)), [0.0], [0]
    for i in range(1, len(word) + 1):
        top, n = best[i - 1] + pieces.byte_score, count[i - 1] + 1
        for k in range(1, min(i, longest) + 1):
            piece = pieces.score.get(word[i - k : i])
            if piece is not None and best[i - k] + piece > top:
                top, n = best[i - k] + piece, count[i - k] + 1
        best.append(top)
        count.append(n)
    return count[-1], best[-1]


@pytest.mark.parametrize("alone", [16, 512])
def test_long_words_equal_the_plain_recurrence(monkeypatch, alone):
    monkeypatch.setattr(token_counts, "ALONE_BYTES", alone)
    pieces = token_counts.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    letters = ["x", "abcdefghijklmnopqrstuvwxyz", "日本語中文字一二三四五六七八九十", "the and of é ß".replace(" ", ""), "\x00\x7f-_=/"]
    texts = ["".join(rng.choice(list(a), n)).encode() for a in letters for n in (49, 200, 700)] + [b"international" * 20]
    ends = np.cumsum([len(t) for t in texts])
    tokens, scores = token_counts.long_counts(np.frombuffer(b"".join(texts) + bytes(8), np.uint8), np.append(0, ends[:-1]), ends, pieces)
    for t, n, score in zip(texts, tokens, scores, strict=True):
        want = plain_segment(token_counts.MARK + t, pieces)
        assert n == want[0] and score == pytest.approx(want[1], rel=1e-9)
        assert token_counts.segment(token_counts.MARK + t, pieces) == want


def test_unspaced_text_is_not_slow():
    import time

    pieces = token_counts.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    text = "".join(np.random.default_rng(1).choice([chr(c) for c in range(0x4E00, 0x5E00)], 350_000)).encode()
    began = time.process_time()
    n, _ = token_counts.long_counts(np.frombuffer(text + bytes(8), np.uint8), np.array([0]), np.array([len(text)]), pieces)
    assert n[0] > 350_000 and time.process_time() - began < 3  # a MB of text


def test_token_counts(odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.Pieces.load(path)
    want = sorted(((r[0] is not None, r[0] or 0), *(lambda s: (len(s), sum(a for a, _ in s), round(sum(b for _, b in s), 4)))([token_counts.segment(token_counts.MARK + w.encode(), pieces) for w in words(r[1])])) for r in awkward())
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_words"], r["n_tokens"], round(r["log_prob"], 4)) for r in token_counts.counted(odd, path).collect())
    assert got == want and token_counts.counted(none, path).count() == 0


def test_best_segmentation_is_best():
    pieces = token_counts.Pieces.of(["▁a".encode(), b"b", "▁".encode(), b"ab", b"bb", b"a"])

    def all_ways(word):
        if not word:
            yield 0.0
        for k in range(1, len(word) + 1):
            s = pieces.score.get(word[:k], pieces.byte_score if k == 1 else None)
            if s is not None:
                yield from (s + rest for rest in all_ways(word[k:]))

    for text in (b"abab", b"bbb", b"zab", b"aabba"):
        word = token_counts.MARK + text
        data = np.append(np.frombuffer(text, np.uint8), np.zeros(8, np.uint8))
        n, score = token_counts.trie_counts(data, np.array([0]), np.array([len(text)]), pieces)
        assert score[0] == pytest.approx(max(all_ways(word))) and (n[0], pytest.approx(score[0])) == token_counts.segment(word, pieces)


def test_an_id_of_many_rows_fills_many_files(spark, tmp_path):
    """One id with different texts, and one row over and over: every partition has its part, in order."""
    rows = [(7, f"text number {i}") for i in range(900)] + [(3, "the same")] * 900
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path}/t", BYTE, 50_257, 0, shards=8)
    sizes = [r["n"] for r in manifest.groupBy("shard").agg(F.sum("n_docs").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 500
    got = sorted((r["start"], r["doc_id"], r["ids_crc32"]) for r in token_files.read(manifest).collect())
    assert [d for _, d, _ in got] == [3] * 900 + [7] * 900 and len({c for _, d, c in got if d == 7}) == 900 and len({c for _, d, c in got if d == 3}) == 1

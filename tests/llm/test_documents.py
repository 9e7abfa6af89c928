"""Operators 3, 5, 6, 7, 9, 10."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callmetrics.llm import coded, decontamination, language, mixing, ngram_join, quality, url_filter
from callmetrics.llm import kernel as K

from ..conftest import SMALL, same_as_sql
from .fixtures import SCHEMA, awkward, lower, words

KEY = lambda i: (i is not None, i or 0)


# 3 ---------------------------------------------------------------------------------------------------------------


def base_scores(rows):
    split = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [*words(lower(t or "")), None]
    count = Counter(w for i, t in rows if not split(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return {i: (split(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_base_scores_and_probabilities(spark, odd):
    got = mixing.score(odd).collect()
    want = base_scores([(r[0], r[1]) for r in awkward()])
    assert len(got) == len(awkward())
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 6:
            split, n, known, train, base = want[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (split, n, known, train)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"]) and r["bits_per_byte"] > 0


def test_model_beats_the_base_on_new_text(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_scores_of_nothing(none):
    assert mixing.score(none).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def alnum(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def brute_contamination(docs, items, window=10):
    grams = {}
    for i, text in items:
        w = alnum(text)
        for k in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = alnum(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=lambda r: (KEY(r[0]), r[1:]))


@pytest.mark.parametrize("block", [1, 1 << 18])
def test_contamination(spark, odd, block):
    import hashlib

    items = [(1, "quick brown fox jumps over the lazy dog and then some other words"), (2, "Three, FOUR"), (2, "two three"), (10, "é ß"), (None, "one two"), (4, None), (5, "..."), (6, "a b c d e f g h a b c d e")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontamination.contamination(odd, df, block_words=block).collect()]
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest(), r[2] > 0) for r in brute_contamination([(r[0], r[1]) for r in awkward()], items)]
    assert sorted(got, key=lambda r: (KEY(r[0]), r[1:])) == sorted(want, key=lambda r: (KEY(r[0]), r[1:]))


def test_equal_windows_in_a_long_text(spark, monkeypatch):
    """Many equal windows, and items that share them, on a text of one word: proposals stay bounded."""
    monkeypatch.setattr(decontamination, "PROPOSALS", 1000)
    docs = spark.createDataFrame([(1, "a " * 30_000), (2, "b"), (3, "a " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(i, "a " * (300 + i)) for i in range(40)] + [(99, "a a b")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontamination.contamination(docs, items).collect()}
    assert got == {1: (30_000, 30_000, 40), 2: (1, 0, 0), 3: (9, 0, 0)}


def test_contamination_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(odd, empty).filter("contaminated OR n_items > 0").count() == 0
    assert decontamination.contamination(none, empty).count() == 0


def test_proximity(spark, odd):
    index = decontamination.build(odd)
    got = sorted((KEY(r["doc_id"]), r["n_pairs"]) for r in decontamination.near(index, "The", "dog", 3).collect())
    want = []
    for r in awkward():
        w = alnum(r[1])
        n = sum(abs(i - j) <= 3 for i, a in enumerate(w) if a == "the" for j, b in enumerate(w) if b == "dog")
        want += [(KEY(r[0]), n)] if n else []
    assert got == sorted(want)


def test_contamination_equals_sql(spark):
    same_as_sql(spark, decontamination.query, decontamination.ORACLE_SQL)


# 6 ---------------------------------------------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    pages = [
        (1, "http://WWW.Example.com/en/x?q=/fr/"), (2, "https://a.example.com/en/"), (3, "http://example.com/EN/"), (4, "http://xexample.com/en/a"), (5, "http://a.net/es/1#top"), (6, "http://a.net/de/"),
        (7, None), (8, "no scheme/es/"), (9, "http://"), (10, "a://b://c.net/fr/"), (11, "http://com/"), (12, "http://com"), (13, "http://x.net?/es/"), (14, "//x.com/"), (15, ""), (15, ""),
    ]
    df = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in pages], "page_id long, url string, html string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df, [url_filter.Rule(*r) for r in url_filter.RULES]).collect()}
    assert {i: got[i]["rule"] for i in range(1, 16)} == {1: "www.example.com/en/", 2: "example.com/en/", 3: "com/", 4: "com/", 5: "net/es/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: "com/", 12: None, 13: None, 14: None, 15: None}
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/x") and (got[10]["host"], got[10]["path"]) == ("b:", "//c.net/fr/")
    assert (got[7]["host"], got[7]["path"], got[9]["host"], got[13]["path"]) == ("", "", "", "")
    assert got[5]["verdict"] == "block" and got[6]["verdict"] == "block" and got[4]["verdict"] == "allow" and got[12]["verdict"] == "allow"


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(3)
    hosts = [f"h{i}" for i in range(30)]
    links = Counter((rng.choice(hosts), rng.choice(hosts)) for _ in range(200))
    links = {e: n for e, n in links.items() if e[0] != e[1] and e[0] != "h5" and e[1] != "h6"}
    trust, bad = {"h0": 0.5, "h1": 0.5}, {"h2": 1.0}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "src string, dst string, links long")
    seeds = spark.createDataFrame([(h, trust.get(h, 0.0), bad.get(h, 0.0)) for h in hosts], "host string, trust_seed double, distrust_seed double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, seeds, iterations=7).collect()}
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    t, d = dict(trust), dict(bad)
    for _ in range(7):
        lost_t, lost_d = sum(x for h, x in t.items() if not out[h]), sum(x for h, x in d.items() if not into[h])
        t = {h: (0.15 + 0.85 * lost_t) * trust.get(h, 0) + 0.85 * sum(t.get(a, 0) * n / out[a] for (a, b), n in links.items() if b == h) for h in hosts}
        d = {h: (0.15 + 0.85 * lost_d) * bad.get(h, 0) + 0.85 * sum(d.get(b, 0) * n / into[b] for (a, b), n in links.items() if a == h) for h in hosts}
    assert sum(t.values()) == pytest.approx(1) and sum(d.values()) == pytest.approx(1)
    assert all(got[h] == pytest.approx((t[h], d[h])) for h in hosts)


def test_ties_and_long_lists_of_rules(spark, monkeypatch):
    rules = [url_filter.Rule(*r) for r in (*url_filter.RULES, ("allow", "abc.com/x"), ("block", "abc.com/x"), ("block", "b.co/"), ("allow", "b.co/"))]
    urls = ["http://abc.com/xy", "http://b.co/", "http://a.b.co", "http://www.example.com/en/1", "http://example.com/en/", "http://net/es/", "http://x.y.net/fr/z", "", None, "http://.com/", "http://a..com/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    short = sorted(map(str, url_filter.ruled(df, rules).collect()))
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 0)
    assert sorted(map(str, url_filter.ruled(df, rules).collect())) == short
    got = {r["page_id"]: r["rule_verdict"] for r in url_filter.ruled(df, rules).collect()}
    assert got[0] == "block" and got[1] == "block" and got[2] is None and got[3] == "allow"


def test_verdicts_equal_a_plain_version(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()
    out = []
    for r in pages:
        rest = (r["url"] or "").partition("://")[2] if "://" in (r["url"] or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = lower(rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(n), n, v) for v, n in url_filter.RULES if (host == n.partition("/")[0] or host.endswith("." + n.partition("/")[0])) and path.startswith("/" + n.partition("/")[2])]
        out.append((r["page_id"], host, path, *(max(fits)[1:] if fits else (None, None))))
    n = Counter(v for *_, v in out)
    per = Counter((h, v) for _, h, _, _, v in out)
    bad = {h for _, h, *_ in out if per[h, "block"] / max(1, n["block"]) > per[h, "allow"] / max(1, n["allow"])}
    want = sorted((i, h, p, r or "", v or ("block" if h in bad else "allow")) for i, h, p, r, v in out)
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in url_filter.query(spark, SMALL).collect())
    assert got == want


def test_links_of_pages(spark):
    html = '<a href="http://b.org/x">1</a><A HREF=\'//c.org\'>2</a><a href="/own">3</a><a href=https://b.org>4</a><a href="http://a.com/self">5</a>'
    df = spark.createDataFrame([(1, "http://a.com/", html), (2, "http://a.com/2", None)], "page_id long, url string, html string")
    edges = url_filter.host_edges(url_filter.ruled(df, []))
    assert sorted(map(tuple, edges.collect())) == [("a.com", "b.org", 2), ("a.com", "c.org", 1)]
    # A host that nobody judges is blocked for linking to a blocked one.
    pages = [(1, "http://bad.net/es/", ""), (2, "http://friend.org/", '<a href="http://bad.net/es/">'), (3, "http://other.org/", "")]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [url_filter.Rule("block", "net/es/")]).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), []).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_components(docs, n=5, percent=80):
    sets = []
    for _, text in docs:
        w = words(lower(text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(docs)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((KEY(doc), len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(docs)), key=str)


def groups_of(rows):
    return sorted(((KEY(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows), key=str)


def near_copies(seed, families=6, members=25, size=120):
    """Families of texts with a few words changed, some of which only link by way of others."""
    rng, docs = random.Random(seed), []
    for f in range(families):
        text = [f"{f}x{rng.randrange(400)}" for _ in range(size)]
        for _ in range(members):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                copy[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(copy[: rng.choice([size, size, size - 10])]))
            text = copy if rng.random() < 0.2 else text
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_groups_of_awkward_documents(odd, none):
    docs = [(r[0], r[1]) for r in awkward()]
    assert groups_of(ngram_join.join(odd).collect()) == brute_components(docs)
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_of_near_copies_is_lost(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert groups_of(ngram_join.join(df).collect()) == brute_components(docs)


def test_a_large_family_half_of_whose_pairs_are_linked(spark):
    rng = random.Random(11)
    base, docs = [f"w{rng.randrange(500)}" for _ in range(150)], []
    for _ in range(500):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 9])):
            copy[rng.randrange(150)] = rng.choice(base) if rng.random() < 0.5 else f"new{rng.randrange(40)}"
        docs.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert groups_of(ngram_join.join(df).collect()) == brute_components(list(enumerate(docs)))


def test_cuts_part_the_order_evenly():
    volume = [0] * 256
    volume[4], volume[8], volume[40] = 1000, 3000, 4000
    cuts = ngram_join.cuts_of(volume, 4)
    assert len(cuts) == 3 and (np.diff(cuts.astype(float)) > 0).all()
    assert [int(c >> K.U64(56)) for c in cuts] == [8, 40, 40] or [int(c >> K.U64(56)) for c in cuts] == [8, 8, 40]
    assert len(ngram_join.cuts_of([0] * 256, 4)) == 3


def test_counts_beyond_32_bits(spark, odd):
    big = np.array([0, 1, 1 << 31, (1 << 40) + 7])
    for x in (big, big[:2], big[:0]):
        assert coded.of_counts(pa.scalar(coded.counts(x), pa.binary())).tolist() == x.tolist()
    slices = coded.coded(odd)
    keys = lambda s: (np.array([5, 1 << 63], K.U64), np.array([3_000_000_000, 1]))
    n = slices.count()
    r = coded.totals(slices, keys, 3, whole=True, frequent=3 * 10**9).agg(F.sum("n_keys"), F.sum("n_sum"), F.max("frequent")).first()
    assert r[:2] == (2, n * 3_000_000_001) and bytes(r[2]) == (5).to_bytes(8, "little")


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    group = {}
    for a, b in edges:
        for x in (a, b):
            group.setdefault(x, x)
    for _ in range(200):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == group[x] for x in group)


def test_groups_equal_sql(spark):
    same_as_sql(spark, ngram_join.query, ngram_join.ORACLE_SQL)


@pytest.mark.parametrize("whole", [False, True])
def test_totals_over_slices(spark, odd, whole):
    slices = coded.coded(odd)
    keys = lambda s: (np.sort(s.hashes()), np.bincount(s.number, minlength=len(s.start))[np.argsort(s.hashes())])
    r = coded.totals(slices, keys, 3, whole=whole).agg(F.sum("n_keys"), F.sum("n_sum")).first()
    count = Counter(w for row in awkward() for w in words(lower(row[1] or "")))
    assert tuple(r) == (len(count), sum(count.values()))


# 9 ---------------------------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measurements(odd, none):
    got = sorted(((KEY(r["doc_id"]), *(r[m] for m in quality.MEASURES[:5]), r["base_failed"]) for r in quality.judged(odd).collect()), key=str)
    want = sorted(((KEY(r[0]), *(m := brute_measures(r[1])), m[0] < 20 or 100 * m[4] > 30 * m[0]) for r in awkward()), key=str)
    assert got == want and quality.judged(none).count() == 0


def test_policies_and_ablation(odd):
    book = quality.ledger(odd).cache()
    for name, policy in quality.POLICIES.items():
        kept = book.filter(quality.passes(policy)).count()
        assert kept == quality.passing(odd, policy).count(), name
        for r in quality.ablation(book, policy).collect():
            rest = tuple(p for p in policy if p != r["rule"])
            assert r["n_alone"] == book.filter(quality.passes(rest)).count() - kept
            assert r["n_failed"] == book.filter(~quality.passes((r["rule"],))).count()
    assert quality.passing(odd, quality.POLICIES["v1"]).columns == odd.columns


def test_quality_equals_sql(spark):
    same_as_sql(spark, quality.query, quality.ORACLE_SQL)
    same_as_sql(spark, quality.ablated, quality.ABLATION_SQL)


# 10 --------------------------------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    net = language.Network.new(["a", "b", "c"], hidden=4, seed=1)
    for k in net.weights:
        net.weights[k] = net.weights[k].astype(np.float64)
    words_, length, target = np.array([[97, 98, 99, 100], [98, 98, 97, 0], [99, 0, 0, 0]], np.uint8), np.array([4, 3, 1]), np.array([0, 2, 1])

    def loss():
        out = net.label(words_, length)
        return -sum(np.log(p[np.arange(len(p)), target[: len(p)]]).sum() for p in out) / length.sum()

    grad, rng = net.gradient(words_, length, target), np.random.default_rng(0)
    for k, g in grad.items():
        places = [tuple(x) for x in np.argwhere(g != 0)]
        for i in rng.permutation(len(places))[:6]:
            at, e = places[i], 1e-3
            old = net.weights[k][at]
            net.weights[k][at] = old + e
            up = loss()
            net.weights[k][at] = old - e
            down = loss()
            net.weights[k][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=1e-5), (k, at)


def test_held_out_accuracy(spark):
    got = language.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score"), F.max("score")).first()
    assert r["right"] > 0.97 and r[1] >= 0 and r[2] <= 1


def test_probabilities_do_not_depend_on_neighbours():
    net = language.Network.new(["a", "b"], seed=3)
    texts = [None, "", "Hello wörld again", "x" * 100 + " y", "123", "hello WÖRLD"]
    whole = language.probabilities(net, K.texts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert language.probabilities(net, K.texts(pa.array([t], pa.string())))[0] == pytest.approx(whole[i], abs=1e-6)
    assert (whole[[0, 1, 4]] == 0).all()


def test_all_languages_are_learned(spark):
    rng = random.Random(2)
    alphabets = [[chr(0x100 + 40 * k + j) for j in range(12)] for k in range(70)]
    docs = [(70 * i + k, " ".join("".join(rng.choices(a, k=5)) for _ in range(40)), f"l{k:02d}") for k, a in enumerate(alphabets) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    net = language.fit(df)
    assert len(net.names) == 70
    r = language.identify(df, net).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert r[0] > 0.6


def test_query_equals_a_plain_network(spark):
    """Each word of each document by itself, against the operator with its shared words."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.query(spark, SMALL).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        data = np.frombuffer(lower(r["text"] or "").encode() + b" ", np.uint8)
        total, size, word = np.zeros(len(net.names)), 0, b""
        for b in data.tolist():
            if 97 <= b <= 122 or b >= 128:
                word += bytes([b])
                if len(word) < language.WORD_BYTES:
                    continue
            if word:
                total += sum(p[0] for p in net.label(np.frombuffer(word, np.uint8)[None], np.array([len(word)])))
                size, word = size + len(word), b""
        if size:
            assert got[r["doc_id"]] == (net.names[int(total.argmax())], pytest.approx(total.max() / size, abs=1e-4))


def test_unknown_language(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "lang_pred")
    net = language.fit(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in language.identify(docs, net).collect() if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 14, 17)) and got[3]["lang_pred"] != "und" and len(got) == len({r[0] for r in awkward()} - {None})
    assert language.fit(none.select("doc_id", "text", "lang")) is None
    assert language.identify(docs, None).filter("lang_pred <> 'und'").count() == 0 and language.identify(none.select("text"), net).count() == 0

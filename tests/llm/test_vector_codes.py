"""Operator 12."""

import hashlib
import math
import random

import numpy as np
import pytest

from callmetrics.llm import vector_codes as V

from ..conftest import same_as_sql

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, code int, error string"


def plain(rows, parts=16, entries=64, rounds=2):
    """The codes by integers alone, without bounds."""
    good = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % parts == 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    order = lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * float(np.float32(x))) for x in r[1]])
    good.sort(key=order)
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    if not good:
        return []
    width = len(good[0][1]) // parts
    cut = [[tuple(order(r)[2][p * width : (p + 1) * width]) for p in range(parts)] for r in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]  # noqa: B023
        if i < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                    if own:
                        books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for r, e in zip(good, errors, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], bytes(k).hex(), e, by[r[2]], digest) for r, k, e in zip(good, codes, errors, strict=True)), key=repr)


def awkward(n=150):
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(32)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(n)]
    rows += [(i, rows[3][1], 2) for i in range(n, n + 40)]  # copies
    rows += [(3, rows[3][1], 2), (3, rows[4][1], 2), (None, vector(), None), (None, rows[3][1], 0), (-7, vector(), 1)]
    rows += [(500, None, 1), (501, [None, *vector()[1:]], 1), (502, [float("nan"), *vector()[1:]], 1), (503, [float("inf"), *vector()[1:]], 1), (504, [], 1), (505, vector()[:16], 1), (506, vector()[:30], 1)]
    return [(*r, "clash", 7, "clash") for r in rows]


@pytest.fixture
def registered(spark, monkeypatch):
    """The query over rows in place of the table."""

    def run(rows):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)

        class Reader:
            parquet = staticmethod(lambda path: frame)

        class Session:
            read = Reader

        return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in V.query(Session, "").collect()), key=repr)

    return run


def test_codes_of_awkward_vectors(registered):
    rows = awkward()
    assert registered(rows) == plain(rows)


def test_few_vectors_and_ties(registered):
    one = [(1, [0.5] * 16, 0)]
    ties = [(i, [float(i % 3)] * 16, None) for i in range(9)]
    for rows in (one, ties, one * 3):
        rows = [(*r, "c", 1, "c") for r in rows]
        assert registered(rows) == plain(rows)
    assert registered([]) == []


def test_large_components(spark):
    """Beyond +-2**28 an integer stays there."""
    rows = [(i, [3e38 * (-1) ** i] + [float(i)] * 15, 0, "", 0, "") for i in range(4)]
    codes, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    assert set(np.abs(books.history[0][0]).reshape(-1)) == {V.LIMIT}
    assert all(r["error"] == 0 for r in codes.collect())


def test_distances_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 20, V.LIMIT):
        x, book = rng.integers(-most, most, (40, 4)), rng.integers(-most, most, (64, 4))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x]
        assert (V.distances(x, book) == np.array(want)).all()


def test_bounds_spare_measurements_and_change_nothing():
    rng = np.random.default_rng(2)
    centers = rng.integers(-2000, 2000, (2, 64, 4))
    x = (centers[:, rng.integers(0, 64, 4000)] + rng.integers(-60, 60, (2, 4000, 4))).transpose(1, 0, 2)
    books, state = V.Codebooks([np.ascontiguousarray(x[:64].transpose(1, 0, 2))]), (None, None, None)
    measured = []
    for _ in range(6):
        code, bound, stamp, error, n = V.assign(x, books, *state)
        for p in range(2):
            d = V.distances(x[:, p], books.now[p])
            assert (code[:, p] == d.argmin(axis=1)).all() and (error[:, p] == d.min(axis=1)).all()
        state, measured = (code, bound, stamp), [*measured, int(n.sum())]
        nxt = books.now.copy()
        for p in range(2):
            for e in range(64):
                if (code[:, p] == e).any():
                    nxt[p, e] = x[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
        books.history.append(nxt)
    assert measured[0] == 8000 and measured[-1] < 800
    assert len(set(state[2].reshape(-1).tolist())) > 1  # bounds of several rounds are in use


def test_net_displacement_is_tighter_than_drifts():
    """An entry that goes out and comes back has no net displacement."""
    home = np.zeros((1, 3, 2), np.int64) + np.arange(3)[None, :, None] * 100
    out = home.copy()
    out[0, 1] += 40
    books = V.Codebooks([home, out, home])
    assert (books.displacement(0) == 0).all()
    assert books.displacement(1).tolist() == [[pytest.approx(40 * 2**0.5), 0.0, pytest.approx(40 * 2**0.5)]]


def test_vectors_come_back(spark):
    rows = awkward()
    codes, books = V.compress(spark.createDataFrame(rows, SCHEMA))
    errors = {(r["vec_id"], bytes(r["code"])): r["error"] for r in codes.collect()}
    whole = {r[0]: r[1] for r in rows if r[0] is not None and r[0] > 10 and r[0] < 150}
    for r in V.restored(codes, books).collect():
        if r["vec_id"] in whole:
            want = sum((math.floor(256 * float(np.float32(a))) - round(256 * b)) ** 2 for a, b in zip(whole[r["vec_id"]], r["vector"], strict=True))
            assert want in [e for (i, _), e in errors.items() if i == r["vec_id"]]


def test_sql(spark):
    same_as_sql(spark, V.query, V.ORACLE_SQL)

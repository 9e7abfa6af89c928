"""Operator 13."""

import hashlib
import random
import zlib

import pytest

from callmetrics.llm import prefix_trie as P

from ..conftest import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string, pos string, key int, size string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sequences(rows):
    """Rebuilt conversations, by the contract's words."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in below)
    ends = {n: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)).encode()).hexdigest() for n, m in members.items()}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], ends[n]) for n, m in members.items()), key=repr)


def awkward(n=60, seed=3):
    rng = random.Random(seed)
    openings = [[("system", "you are"), ("user", "hello"), ("assistant", "hi")], [("system", "you are"), ("user", "hello"), ("assistant", "hey")], []]
    rows = []
    for c in range(-12, n):
        seq = rng.choice(openings) + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é" * 3, ""])) for _ in range(rng.choice([0, 1, 2, 5, 9, 14]))]
        rows += [(c * rng.choice([1, 1, 3]) if c > 40 else c, i, r, t) for i, (r, t) in enumerate(seq)]
    rows += [(100, i, "user", "same") for i in range(30)] + [(105, i, "user", "same") for i in range(30)] + [(106, i, "user", "same") for i in range(33)]
    rows += [(c, i, "user", "copy") for c in range(200, 260) for i in range(12)]  # a group of copies
    rows += [(300, None, None, None), (300, 1, "user", None), (300, 1, "user", None), (300, 1, "assistant", "later"), (None, 0, "user", "nobody"), (401, 0, "", "short"), (402, 7, "user", "x" * 5000)]
    rng.shuffle(rows)
    return [(*r, "clash", 1, "clash") for r in rows]


def ran(spark, rows, monkeypatch, **bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(P, name, value)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in P.trie(*P.rebuilt(P.turns(frame))).collect()), key=repr)


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 3, "PART": 2, "IDS": 4}])
def test_trie_of_awkward_conversations(spark, monkeypatch, bounds):
    rows = [r for r in awkward() if (r[0], r[1]) != (300, 1)] + [(300, 1, "user", "once", "", 1, "")]
    assert ran(spark, rows, monkeypatch, **bounds) == plain(sequences(rows))


def test_equal_turn_numbers(spark, monkeypatch):
    """Turns of one number are in an order that depends on nothing but themselves."""
    rows = awkward()
    first = ran(spark, rows, monkeypatch)
    assert first == ran(spark, rows[::-1], monkeypatch)
    assert sum(r[3] for r in first if r[1] == 0) == len(sequences(rows))


def test_turnless_and_none(spark, monkeypatch):
    """Conversations whose first turns all fall away end at the root."""
    ids = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    rows = [(c, i, "user", f"{c} {i}", "", 1, "") for c in ids for i in range(2)]
    got = ran(spark, rows, monkeypatch)
    assert got == plain(sequences(rows)) and len(got) == 1 and got[0][3] == 3
    assert ran(spark, [], monkeypatch) == []


def test_sql(spark):
    same_as_sql(spark, P.query, P.ORACLE_SQL)

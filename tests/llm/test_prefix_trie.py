"""Prefix trie: sparse tables and whole tries against plain Python, in blocks of any size."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from boutique.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, place string, len int"


def table(spark, rows):
    """Conversations with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), tie, role, text))
    said = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = said.get(c - int(np.fmod(c, 20)), [])[:h] + said[c][h:]
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
             sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()]


def check(spark, rows, block=None):
    got = prefix_trie.trie(table(spark, rows), block)
    assert got.columns == prefix_trie._COLUMNS
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows), key=key)


def test_sparse_table(rng):
    values = np.array([rng.randrange(6) for _ in range(200)])
    t = prefix_trie.SparseTable(values)
    at, depth = np.array([rng.randrange(200) for _ in range(500)]), np.array([rng.randrange(7) for _ in range(500)])
    for i, d, lo, hi in zip(at, depth, t.left(at, depth), t.right(at, depth), strict=True):
        a = b = int(i)
        while a > 0 and values[a] >= d:
            a -= 1
        while b + 1 < 200 and values[b + 1] >= d:
            b += 1
        assert (a, b) == (lo, hi)
    end = np.minimum(at + 1 + np.arange(500) % 40, 200)
    assert t.minimum(at, end).tolist() == [values[a:b].min() for a, b in zip(at, end, strict=True)]


def many(rng, n):
    """Few texts, so that prefixes are shared; copies, nulls, ties, repeated rows."""
    rows = []
    for c in [*range(n), -3, -25, 1007]:
        for turn in range(rng.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b\n c", "", None, "é ü"])))
    rows += [r for r in rows if r[0] == 7] + [(None, 0, "user", "x")] * 5
    same = [(k, "user" if k % 2 == 0 else "assistant", f"t {k}") for k in range(6)]
    rows += [(5000 + c, *t) for c in range(60) for t in same[:6 - c % 2]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 16, None])
def test_against_plain_trie(spark, rng, block):
    check(spark, many(rng, 60), block)


def test_long_conversations(spark, rng, monkeypatch):
    """A copy, a shared half, a lone tail and one that ends within another's chunk."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    long = [("user", f"turn {k}") for k in range(60)]
    alone = [("user", f"other {k} {rng.random()}") for k in range(200)]
    rows = []
    for c, turns in ((4, long), (8, long), (104, long[:30] + alone[:50]), (40, alone), (44, long[:37]), (49, alone[:3])):
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    for block in (2, None):
        check(spark, rows, block)


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(table(spark, [(1, 0, "a", "b")]).filter("false")).count() == 0
    check(spark, [(None, 0, "a", "b")])
    short = [(c, 0, "user", "x") for c in range(1, 40)]  # families without a head, and no turn after the first h
    check(spark, short, 4)

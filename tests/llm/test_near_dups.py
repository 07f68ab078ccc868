"""Op 5: alignment against the full table, classes against all pairs."""

import random

import numpy as np
import pytest

from boutique.llm import near_dups
from boutique.llm.near_dups import alike
from tests.llm.conftest import words


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        kind = rng.random()
        if kind < 0.4:
            text[k] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7 and len(text) > 1:
            text.pop(k)
        else:
            text.insert(k, f"ins{rng.randrange(10**6)}")
    return text


def test_alignment_equals_full_table(rng):
    a, b = [], []
    for k in range(300):
        x = [rng.randrange(9 if k % 2 else 1000) for _ in range(rng.randint(1, 90))]
        y = [hash(w) % 1000 if isinstance(w, str) else w for w in changed(rng, x, rng.randint(0, len(x) // 3 + 1))]
        a.append(np.array(x, np.int64))
        b.append(np.array(y, np.int64))
    want = [edits(x.tolist(), y.tolist()) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    assert alike(a, b).tolist() == want and 20 < sum(want) < 290


def test_sketch_keeps_order():
    """The same k-mers in another order give other keys."""
    import pyarrow as pa

    from boutique.llm.arrays import TERM_WORDS, Words

    first, second = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    _, keys = near_dups.sketches(Words(pa.array([f"{first} {second}", f"{second} {first}", f"{first} {second}"]), TERM_WORDS))
    assert (keys[0] == keys[2]).all() and 0.05 < (keys[0] == keys[1]).mean() < 0.9


@pytest.mark.parametrize("per_member", [32, 0])
def test_classes(spark, corpus, monkeypatch, per_member):
    """per_member 0: every member of a bucket is a part of its own."""
    monkeypatch.setattr(near_dups, "PAIRS_PER_MEMBER", per_member)
    rng = random.Random(7)
    passage = words(rng, 60)
    rows, group = [], {}
    for g in range(12):
        base = words(rng, rng.randint(30, 200))
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), changed(rng, base, rng.randint(0, len(base) // 25))))
            group[len(rows) - 1] = g
    for g in range(12, 42):  # a shared passage doesn't make near-duplicates
        at = words(rng, 40)
        rows.append((len(rows), at[:20] + passage + at[20:]))
        group[len(rows) - 1] = g
    texts = [(i, " ".join(w).upper() + "!" if i % 2 else " ".join(w)) for i, w in rows]
    odd = [(1000, None), (1001, ""), (1002, "?!"), (1003, "one two"), (1004, "One, two."), (1005, "one three"), (1006, texts[0][1]), (1006, texts[0][1]),
           (None, "null id here and more words"), (1007, "null id here and more words"), (1008, "x " * 30000), (1009, "x " * 29999)]
    docs = corpus(texts + odd)
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == len(texts) + len(odd)
    class_of = {r.doc_id: r.class_id for r in got}
    smallest: dict = {}
    for i, g in group.items():
        smallest.setdefault(g, i)
    assert {i: class_of[i] for i in group} == {i: smallest[g] for i, g in group.items()}
    assert [class_of[i] for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, 1007, None, 1008, 1009)] == [1000, 1001, 1002, 1003, 1003, 1005, 0, 1007, 1007, 1008, 1008]
    kept = near_dups.first_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*smallest.values(), 1000, 1001, 1002, 1003, 1005, 1007, 1008})


def test_repeated_rows_and_empty(corpus):
    assert near_dups.first_documents(corpus([(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g")])).count() == 1
    assert near_dups.near_duplicates(corpus([])).count() == 0 == near_dups.first_documents(corpus([])).count()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.getrandbits(62), rng.getrandbits(62)) for _ in range(5)]
    path = [rng.getrandbits(62) for _ in range(40)]
    edges += list(zip(path, path[1:])) + [(path[0], path[20])] * 3
    got = {r.node: r.root for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[p] for p in path} == {min(path)} and all(got[a] == got[b] == min(a, b) for a, b in edges[:5])


def merged(pairs, n):
    """Smallest member of each one's class."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def passage_pairs(rng, n, share, length=200):
    """``n`` pairs of texts at 80 to 95 % edit similarity; all texts share a passage, but no
    two pairs are alike."""
    passage = words(rng, int(length * share), 10**6)
    texts = []
    for _ in range(n):
        base = words(rng, length - len(passage), 10**6)
        at = rng.randrange(len(base))
        base = base[:at] + passage + base[at:]
        texts += [base, changed(rng, base, rng.randint(length // 20, length // 5))]
    return texts


def compared(texts):
    """(all alike pairs, those that share a key), by all pairs."""
    import pyarrow as pa

    from boutique.llm.arrays import TERM_WORDS, Words

    column = Words(pa.array([" ".join(t) for t in texts]), TERM_WORDS)
    _, keys = near_dups.sketches(column)
    rows = [column.hashes[a:b].astype(np.uint32).astype(np.int64) for a, b in zip(column.offsets[:-1], column.offsets[1:])]
    a, b = np.triu_indices(len(texts), 1)
    near = np.array(alike([rows[i] for i in a], [rows[i] for i in b]))
    a, b = a[near], b[near]
    shares = (keys[a] == keys[b]).any(axis=1)
    return list(zip(a.tolist(), b.tolist())), list(zip(a[shares].tolist(), b[shares].tolist()))


@pytest.mark.parametrize("tile", [None, 16])
def test_members_of_a_bucket_are_compared(corpus, monkeypatch, tile):
    """All pairs sharing a key of two k-mers, though the buckets' leaders are unlike both."""
    if tile:
        monkeypatch.setattr(near_dups, "PAIRS_PER_MEMBER", tile)
    texts = passage_pairs(random.Random(3), 150, 0.6)
    everything, sharing = compared(texts)
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(corpus([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert 100 < len(sharing) <= len(everything) < 300
    want = merged(sharing, len(texts))
    assert all(got[a] == got[b] for a, b in sharing)
    assert sum(got[i] == want[i] for i in got) > 0.99 * len(got)


@pytest.mark.parametrize("length", [40, 300])
@pytest.mark.parametrize("similarity", [0.80, 0.85, 0.90, 0.95])
def test_recall_by_edit_similarity(length, similarity):
    """Share of pairs with so many words replaced that have a key in common: 0.9 at least."""
    import pyarrow as pa

    from boutique.llm.arrays import TERM_WORDS, Words

    rng = random.Random(int(100 * similarity) + length)
    texts = []
    for _ in range(400):
        base = words(rng, length, 10**6)
        other = list(base)
        for k in rng.sample(range(length), round(length * (1 - similarity))):
            other[k] = f"new{rng.randrange(10**9)}"
        texts += [" ".join(base), " ".join(other)]
    _, keys = near_dups.sketches(Words(pa.array(texts), TERM_WORDS))
    assert (keys[0::2] == keys[1::2]).any(axis=1).mean() >= 0.9


def test_links_at_the_threshold_end_to_end(corpus):
    """Pairs at 80 to 82 % similarity, some around one passage: nearly all are classes, and no
    two different pairs are one."""
    rng = random.Random(9)
    rows, passage = [], words(rng, 60, 10**6)
    for k in range(150):
        base = words(rng, 200, 10**6)
        if k % 3 == 0:
            base[70:130] = passage
        other = list(base)
        for at in rng.sample(range(200), rng.randint(36, 40)):
            other[at] = f"new{rng.randrange(10**9)}"
        rows += [" ".join(base), " ".join(other)]
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(corpus(list(enumerate(rows)))).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in range(150))
    assert found >= 0.9 * 150 and all(c // 2 == i // 2 for i, c in got.items())

"""Merkle manifest: layout arithmetic, proofs against a plain tree, hostile rows."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutique.llm import manifest


def h(text):
    return sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        i //= 3
    return out


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout_is_a_bijection_with_halves_together(levels):
    slots = np.concatenate([manifest.addresses(levels, d, np.arange(3**d)) for d in range(levels)])
    assert sorted(slots.tolist()) == list(range(manifest.size(levels)))
    top = levels // 2
    upper = [manifest.addresses(levels, d, np.arange(3**d)) for d in range(top)]
    assert not upper or np.concatenate(upper).max() == manifest.size(top) - 1
    first = [manifest.addresses(levels, top + d, np.arange(3**d)) for d in range(levels - top)]  # below the first bottom root
    assert sorted(np.concatenate(first).tolist()) == list(range(manifest.size(top), manifest.size(top) + manifest.size(levels - top)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 28, 100])
def test_block_against_plain_tree(n):
    leaves = [h(str(k)) for k in range(n)]
    levels = plain_levels(leaves)
    slots = manifest.build([bytes.fromhex(x) for x in leaves], len(levels))
    assert slots[0].tobytes().hex() == levels[-1][0]
    for i, path in enumerate(manifest.siblings(slots, n, len(levels))):
        assert path == plain_path(levels, i)
        assert manifest.fold(leaves[i], path) == levels[-1][0]


def brute_force(rows):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(enc(r[0]) + enc(r[3]) + enc(r[2]) + enc(r[4]) + enc(text))

    by_source = {}
    for r in rows:
        bare = r[1].replace("\n", "") if r[1] is not None else None
        by_source.setdefault(r[3], []).append((r[0], leaf(r, r[1]), leaf(r, bare)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[1] for x in sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in order}
    over = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for q, s in enumerate(order):
        for p, (doc_id, own, claimed) in enumerate(sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = plain_path(trees[s], p) + plain_path(over, q)
            folded = manifest.fold(claimed, path)
            out.append((doc_id, own, trees[s][-1][0], over[-1][0], h("".join(b + a for b, a in path)), folded, folded == over[-1][0]))
    return out


@pytest.mark.parametrize("up", [1, 2, manifest.HEIGHT])
def test_against_brute_force(spark, rng, corpus, up):
    """Several levels of blocks, many sources, null columns, repeated ids, empty texts."""
    sources = ["hot"] * 6 + [None, "", "é", "a", "b"] + [f"s{k}" for k in range(8)]
    rows = [(k // 2 if k % 40 < 2 else k, rng.choice(["", None, "a\nb", "plain", f"t{k}\n"]), rng.choice(["en", None]), rng.choice(sources)) for k in range(150)]
    rows += [(None, "x", None, "hot"), (None, "x", None, "hot"), (-3, "y\n", "de", "hot")]
    docs = corpus(rows)
    full = [(*r, len(r[1] or "")) for r in rows]
    got = manifest.verify(docs, F.replace("text", F.lit("\n"), F.lit("")), up=up).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_force(full), key=key)


def test_single_row_and_empty(spark, corpus):
    one = manifest.verify(corpus([(7, "t", "en", "s")])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].verified
    assert one[0].proof_sha256 == h("")
    assert manifest.verify(corpus([(7, "t", "en", "s")]).filter("false")).count() == 0

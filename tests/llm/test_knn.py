"""Op 2 against all inner products."""

import math
import random

from boutique.llm import knn


def brute(rows, asked, k):
    """Sorted (query_id, rank, vec_id, score): every usable row is a candidate of its own."""
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in usable:
        if asked(qi):
            found = sorted((-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable if j != qi and len(v) == len(q))
            out += [(qi, rank + 1, j, -s) for rank, (s, j) in enumerate(found[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 label", "2 score", "3 rank")


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.random()]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.5] * 6) for i in range(500, 560)]  # ties
    rows += [(600, [1.0, 2.0]), (650, [3.0, -1.0]), (650, [3.0, -1.0])]  # another length; a repeated row
    rows += [(700, None), (701, []), (702, [1.0] * 5 + [None]), (750, [float("nan")] * 6), (703, [float("inf")] * 6), (None, [1.0] * 6)]
    rows = [(i, None if v is None else [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    vectors = knn.quantised(frame(spark, rows))
    for shard, block in ((32, 5), (8192, 16384)):
        got = knn.top_k(vectors.filter("vec_id % 50 = 0"), knn.index(vectors, shard), 5, block)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 50 == 0, 5)


def test_rows_not_ids(spark, monkeypatch):
    """An id's several vectors are as many candidates and queries; large components stay."""
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.0]), (1, [0.8, 0.0]), (2, [0.1, 0.0]), (3, [1e9, 0.0]), (50, [0.0, 1.0]), (50, [-1.0, 1e12]), (4, [-1e12, 1e12]), (2, [0.1, 0.0])]
    vectors = knn.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for values in (1 << 22, 3):  # components of a block
        monkeypatch.setattr(knn, "QUERY_VALUES", values)
        got = knn.top_k(vectors.filter("vec_id % 50 = 0"), knn.index(vectors, 2), 3)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 50 == 0, 3)


def test_bounds_hold_where_terms_cancel():
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.integers(-(1 << 52), 1 << 52, (300, 4))
    queries = rng.integers(-(1 << 40), 1 << 40, (20, 4))
    tree = knn.build(np.arange(300), vectors, leaf=8)
    for node, (a, b) in enumerate(tree.spans.tolist()):
        best = (queries.astype(object) @ tree.vectors[a:b].astype(object).T).max(axis=1)
        assert all(x >= y for x, y in zip(knn._bounds(tree, queries, node).tolist(), best.tolist()))


def test_pruning_leaves_out_nodes():
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 5, (4000, 3)) + 100 * rng.integers(0, 2, (4000, 3))
    tree = knn.build(np.arange(4000), vectors, leaf=16)
    calls = []
    original = knn._products
    try:
        knn._products = lambda q, v: calls.append(len(v)) or original(q, v)
        knn.search(tree, np.array([-1]), vectors[:1] - 50, np.array([knn._LOWEST]), 5)
    finally:
        knn._products = original
    assert sum(calls) < 2000


def test_empty(spark):
    vectors = knn.quantised(frame(spark, []))
    assert knn.top_k(vectors, knn.index(vectors), 5).count() == 0

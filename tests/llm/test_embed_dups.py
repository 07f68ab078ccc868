"""Collision-counting projections: windows, recall and links against all pairs."""

import numpy as np
import pytest

from boutique.llm import embed_dups


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def near(rng, base, cosine):
    """A vector at exactly this cosine to ``base``."""
    side = rng.standard_normal(len(base))
    side -= side @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * unit(side)


def plain(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    linked: list = [[] for _ in rows]
    for length in {len(v) for (_, v), o in zip(rows, ok, strict=True) if o}:
        own = [i for i in range(n) if ok[i] and len(rows[i][1]) == length]
        vectors = np.array([rows[i][1] for i in own], dtype=float)
        cosines = (u := unit(vectors / np.abs(vectors).max(axis=1, keepdims=True))) @ u.T
        for k, i in enumerate(own):
            linked[i] = [own[j] for j in np.flatnonzero(cosines[k] >= 0.95) if j != k]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(linked[i]), component, rows[i][0] == component))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "vec_id long, embedding array<double>, node string, key int, copies int")
    got = embed_dups.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_windows_against_all_pairs():
    values = np.random.default_rng(1).integers(-3000, 3000, (150, embed_dups.COUNTED)).astype(np.int16)
    for window, least in ((1500, 12), (200, 4), (9000, embed_dups.COUNTED)):
        counts = (np.abs(values[:, None].astype(int) - values[None]) <= window).sum(axis=2)
        want = {(a, b) for a in range(150) for b in range(a + 1, 150) if counts[a, b] >= least}
        assert set(zip(*(x.tolist() for x in embed_dups.colliding(values, window, least)), strict=True)) == want


def test_calibration_grows_with_the_logarithm():
    few, many = embed_dups.calibrate(10_000), embed_dups.calibrate(10**9)
    assert few.per_table < many.per_table <= 24 and many.tables < 400 and few.least == many.least
    for plan in (few, many):
        together = embed_dups._same_cell(embed_dups.CELL) ** plan.per_table
        assert (1 - together) ** plan.tables <= embed_dups.MISS


def test_roots(rng):
    n = 60
    pairs = np.array([[rng.randrange(n), rng.randrange(n)] for _ in range(45)])
    root = embed_dups._roots(n, pairs[:, 0], pairs[:, 1])
    want = list(range(n))
    for _ in range(n):
        for a, b in pairs.tolist():
            want[a] = want[b] = min(want[a], want[b])
    assert root.tolist() == want


def test_defined_cases(spark):
    v, w = [1.0, 0.0, 2.0], [0.0, 3.0, 1.0]
    rows = [(1, v), (2, v), (3, [2.0, 0.0, 4.0]), (4, w), (4, v), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]),
            (10, [float("inf"), 1.0]), (None, w), (None, [-1.0, 0.0, -2.0]), (11, [1.0, 0.0]), (12, [1e300, 2e300, 0.0]), (13, [1e-300, 2e-300, 0.0]), (14, [-0.0, 1.0]), (15, [0.0, 5.0])]
    assert found(spark, rows) == sorted(plain(rows), key=str)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dups.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dimension", [64, 16])
def test_recall_at_the_threshold(spark, dimension):
    """Pairs just above the threshold are found, just below never; chains are one component."""
    r = np.random.default_rng(5)
    rows = [(k, unit(r.standard_normal(dimension))) for k in range(900)]
    high = [(1000 + k, near(r, rows[k][1], 0.9501)) for k in range(300)]
    low = [(2000 + k, near(r, rows[300 + k][1], 0.9499)) for k in range(300)]
    rows = [(i, v.tolist()) for i, v in rows + high + low]
    got, want = found(spark, rows), sorted(plain(rows), key=str)
    missed = sum(a != b for a, b in zip(got, want, strict=True))
    assert missed <= 2 and sum(x[1] for x in want) >= 600


def test_dense_clusters_in_parts(spark, monkeypatch):
    """A cluster that no cell splits, larger than a part; equal vectors on top of it."""
    monkeypatch.setattr(embed_dups, "TILE", 64)
    r = np.random.default_rng(6)
    centre = unit(r.standard_normal(32))
    rows = [(k, near(r, centre, 0.99).tolist()) for k in range(300)] + [(300 + k, near(r, centre, 0.975).tolist()) for k in range(100)]
    rows += [(500 + k, rows[k % 3][1]) for k in range(40)] + [(900 + k, unit(r.standard_normal(32)).tolist()) for k in range(200)]
    assert found(spark, rows) == sorted(plain(rows), key=str)

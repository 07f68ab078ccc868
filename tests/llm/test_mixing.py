"""Op 10: targets against plain water-filling, copies against the definition."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boutique.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at the caps, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] >= most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in over}


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "é", "Z", None]), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def rows(rng):
    out = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "s3", None])
        out.append((i, " ".join(["w"] * rng.randint(0, 60)), "en", source))
    return out + [(900, None, "en", "s1"), (901, " \n ", "en", "s2"), (902, "a b c", "en", "s2"), (902, "a b c", "en", "s2"), (None, "x y", "en", "hot"),
                  (903, "w " * 20000, "en", "s3"), (904, None, "en", "blank")]


def test_takes_come_near_targets(spark, corpus):
    own = rows(random.Random(10))
    docs = corpus(own)
    got = mixing.mix_sizes(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in own)
    size = {i: len((t or "").split()) for i, t, *_ in own}
    assert all(r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    source = {i: s for i, _, _, s in own}
    sizes: dict = {}
    for i, t, _, s in own:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(r.target == pytest.approx(target) for r in mine)
        if s != "s3":  # one document is most of s3
            assert abs(sum(r.taken for r in mine) - target) <= 70
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_hot_source_is_spread_and_join_without_broadcast(spark, corpus, monkeypatch):
    docs = corpus(rows(random.Random(10)))
    want = sorted(map(str, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(str, mixing.mix_sizes(docs).collect())) == want


def test_empty(corpus):
    assert mixing.mix_sizes(corpus([])).count() == 0 == mixing.mix_documents(corpus([])).count()
    assert [r.taken for r in mixing.mix_sizes(corpus([(1, None), (2, "")])).collect()] == [0, 0]

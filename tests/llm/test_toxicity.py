"""Op 3: segments against brute force, and planted toxic words."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from boutique.llm import toxicity
from tests.llm.conftest import words


def recursive(scores, a, b):
    """Ruzzo and Tompa's definition: the best segment, then left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0, 0))
    if best[0] <= 0:
        return []
    return recursive(scores, a, best[3]) + [(best[3], best[4], best[0])] + recursive(scores, best[4], b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_segments_equal_definition(scores):
    got = toxicity.segments(np.array(scores, float))
    assert sorted(s for _, _, s in got) == sorted(s for _, _, s in recursive(scores, 0, len(scores)))
    assert all(sum(scores[f:e]) == s for f, e, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_finds_planted_words_and_keeps_clean(spark, corpus):
    rng = random.Random(3)
    rows, toxic = [], set()
    for i in range(600):
        text = words(rng, rng.randint(5, 300), 400)
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vileword", "Foulword,"]))
        rows.append((i, " ".join(text)))
    odd = [(900, None), (901, ""), (902, "... !!"), (903, " ".join(words(rng, 60000, 400)) + " vileword foulword vileword vileword"), (5, rows[5][1]), (None, "foulword vileword foulword")]
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)] + [(3, 1, 0), (None, 1, 1), (410, 1, None)], "doc_id long, quality int, toxic int")
    docs = corpus(rows + odd)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [(r.predicted, int(r.doc_id in toxic)) for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert all(p == y for p, y in held) and all(by_id[i].predicted == 0 for i in (900, 901, 902))
    assert any(60000 - 5 <= s["first"] for s in by_id[903].spans)  # passages at the end of long texts count
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert not toxic & {i for i in left if i is not None} and left.count(5) == 2 and 900 in left


def test_without_labels_or_documents(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score_documents(corpus([(1, "a b"), (2, None)]), labels).collect()} == {0}
    assert toxicity.score_documents(corpus([]), labels).count() == 0

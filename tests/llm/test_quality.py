"""Op 1: the network against a plain computation, and what it learns."""

import random

import numpy as np
import pyarrow as pa

from boutique.llm import quality
from boutique.llm.arrays import column_bytes
from boutique.llm.quality import FILTERS, HALF, WIDTH, Model


def plain(text: bytes, m: Model) -> float:
    """Chunks of two halves, each position's filters, maxima, mean and maximum: by loops."""
    data = np.frombuffer(text or b"\0", np.uint8)
    halves = [(a, min(a + HALF, len(data))) for a in range(0, len(data), HALF)]
    pooled = []
    for a, b in halves:
        values = [np.maximum(sum(m.filters[j][data[p + j] if p + j < len(data) else 0] for j in range(WIDTH)) + m.bias, 0) for p in range(a, b)]
        pooled.append(np.max(values, axis=0))
    chunks = [np.maximum(x, y) for x, y in zip(pooled, pooled[1:])] or pooled
    x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(x @ m.weights + m.intercept)))


def test_equals_plain_convolution():
    rng = np.random.default_rng(0)
    m = Model(rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS).astype(np.float32), rng.normal(size=2 * FILTERS), 0.1)
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 3, HALF, HALF + 1, 3 * HALF, 5 * HALF + 7)]
    texts += [b"short text", b"####", b"", b"%" * 40]
    want = [plain(t, m) for t in texts]
    assert np.allclose(quality.probabilities(*column_bytes(pa.array(texts, pa.binary())), m), want, atol=1e-5)
    # A score is the text's own: alone, in any order, in any batch and over any piece border.
    alone = {t: quality.probabilities(*column_bytes(pa.array([t], pa.binary())), m)[0] for t in texts}
    for _ in range(5):
        some = [texts[k] for k in rng.permutation(len(texts))[:rng.integers(2, len(texts))]]
        got = quality.probabilities(*column_bytes(pa.array(some, pa.binary())), m)
        assert got.tolist() == [alone[t] for t in some]
    whole, by_row = quality.pooled(*column_bytes(pa.array(texts, pa.binary())), m)
    assert (quality.pooled(*column_bytes(pa.array(texts, pa.binary())), m, piece=300)[0] == whole).all()


def test_training_sees_what_scoring_sees():
    """Sampled halves pool to the features that scoring computes for the text."""
    rng = np.random.default_rng(1)
    m = Model(rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS).astype(np.float32), rng.normal(size=2 * FILTERS), 0.1)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, HALF - 1, HALF, HALF + 2, 4 * HALF + 9)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "y": [0, 1] * 3, "digest": [""] * 6, "text": pa.array(texts, pa.binary())})
    (out,) = quality._sampled_halves(iter([batch]))
    sampled = [[bytes(h) for h in t] for t in out.column("halves").to_pylist()]
    y = np.array([0, 1] * 3)
    _, loss = quality._gradient_step(m, sampled, y, np.ones(6))
    p = quality.probabilities(*column_bytes(pa.array(texts, pa.binary())), m)
    assert np.isclose(loss, -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)), atol=1e-5)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    m = Model(rng.normal(size=(WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(size=FILTERS).astype(np.float32), rng.normal(size=2 * FILTERS), 0.1)
    texts = [[bytes(rng.integers(0, 40, n).astype(np.uint8)) for n in sizes] for sizes in ((HALF + 4, HALF + 4, 60), (30,), (0,), (HALF, 7))]
    y, weight = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    grads, loss = quality._gradient_step(m, texts, y, weight)
    for j, byte, f in ((0, 3, 1), (2, 7, 4), (4, 0, 0), (1, 22, 9)):
        step = 1e-2
        m.filters[j, byte, f] += step
        up = quality._gradient_step(m, texts, y, weight)[1]
        m.filters[j, byte, f] -= 2 * step
        down = quality._gradient_step(m, texts, y, weight)[1]
        m.filters[j, byte, f] += step
        assert np.isclose((up - down) / (2 * step), grads[0][j, byte, f], atol=2e-3)


def test_scores_do_not_depend_on_the_partitioning(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, quality.learning_labels(labels, "quality", 3, 1))
    first = {r.doc_id: r.score for r in quality.score(docs.select("doc_id", "text"), model).select("row.doc_id", "score").collect()}
    other = docs.select("doc_id", "text").repartition(7).sortWithinPartitions("doc_id", ascending=False)
    assert {r.doc_id: r.score for r in quality.score(other, model).select("row.doc_id", "score").collect()} == first
    again = quality.train(docs.repartition(5, "text"), quality.learning_labels(labels, "quality", 3, 1))
    assert (again.filters == model.filters).all()


def sample(rng, bad: bool) -> str:
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) + (rng.choice(["***", "%%%", ""]) if bad else "") for _ in range(rng.randint(3, 200)))


def test_learns_and_sees_the_whole_text(spark, corpus):
    rng = random.Random(2)
    rows = [(i, sample(rng, i % 4 == 0)) for i in range(300)]
    late = sample(rng, False) * 200 + sample(rng, True) * 3
    odd = [(900, None), (901, ""), (902, late), (903, sample(rng, False)), (903, sample(rng, False)), (None, "x y")]
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(200)] + [(5, 1, 0), (None, 1, 0), (250, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(corpus(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.95


def test_without_labels_or_documents(spark, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_documents(corpus([(1, "a"), (2, None)]), labels).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(3, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(corpus([(1, "a"), (3, "b")]), one).count() == 2
    assert quality.score_documents(corpus([]), labels).count() == 0

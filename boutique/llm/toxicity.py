"""Operator 3, toxicity: maximum-scoring segments of token log-odds.

Learning (all labelled documents outside the held-out fold):

1. The documents that hold a word (lower-cased, by 64-bit hash) are counted per class in
   ``BUCKETS`` hash buckets: tables of a fixed size, summed in Spark from one compact row
   per task and slice.
2. Each bucket gets the log-odds between the classes under a Dirichlet prior that has the
   words of both classes in their common proportions, weighing ``PRIOR`` times the data.
   Words whose likelihood ratio test (G squared) stays below ``SIGNIFICANT`` count as 0. A
   drift is subtracted, which makes the expected score on clean text negative.
3. Every text is scanned once, in linear time, for its maximal scoring segments (Ruzzo and
   Tompa). Scores of segments in random text follow an extreme-value law: lambda solves
   sum(p * exp(lambda * score)) = 1 over the clean words, and a segment of score s in n
   words has the normalised score lambda * s - ln(n). A document's statistic is the sum of
   that over its significant segments (those above 0), or the best segment's if none is.
4. A logistic curve from that statistic to the label is fitted on a histogram of all
   labelled documents.

Defined cases: null, empty or wordless texts get the score of a text without any scoring
word; without both classes among the labels every score is the share of class 1 (0 if there
are no labels). Documents labelled twice count once, with the larger label; every row of
``documents`` gets a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import TERM_WORDS, Words, slices
from boutique.llm.frames import as_rows, id_remainder, learning_labels, schema_with, stored, with_labels

BUCKETS = 1 << 18
SLICES = 64
PRIOR = 0.1
SIGNIFICANT = 12.0
DRIFT = math.log(2)
LIMIT = 8.0
#: Bins of the calibration histogram over the statistic, -40 to 216.
BINS, LOW, WIDTH = 1024, -40.0, 0.25


@dataclass
class Model:
    scores: np.ndarray  # float32 by bucket, drift subtracted
    lam: float
    slope: float = 0.0
    intercept: float = 0.0

    def probability(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * statistic, -50, 50)))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((3, BUCKETS), np.int64)  # documents clean and toxic, words clean
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), TERM_WORDS)
            y = np.asarray(part.column("y")) == 1
            bucket, rows = _bucket(words.hashes), words.rows
            counts[2] += np.bincount(bucket[~y[rows]], minlength=BUCKETS)
            once = np.unique(rows * BUCKETS + bucket)
            toxic = y[once // BUCKETS]
            counts[1] += np.bincount(once[toxic] % BUCKETS, minlength=BUCKETS)
            counts[0] += np.bincount(once[~toxic] % BUCKETS, minlength=BUCKETS)
    if counts.any():
        yield _slices(range(SLICES), counts)


def _slices(keys, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32())] + [pa.array([x.tobytes() for x in c.reshape(len(keys), -1)], pa.binary()) for c in counts],
        names=["slice", *COUNTS])


def _add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, BUCKETS // SLICES), np.int64)
    key = 0
    for batch in group:
        key = batch.column("slice")[0].as_py()
        for k, c in enumerate(COUNTS):
            for x in batch.column(c):
                total[k] += np.frombuffer(x.as_buffer(), np.int64)
    yield _slices([key], total)


COUNTS = ("clean", "toxic", "clean_words")
_SLICE = "slice int, clean binary, toxic binary, clean_words binary"


def token_scores(clean: np.ndarray, toxic: np.ndarray, clean_words: np.ndarray) -> Model:
    """Scores by bucket, from the documents of each class that hold it, and the
    extreme-value decay, from the frequency of the bucket's words in clean text."""
    both = clean + toxic
    if not toxic.sum() or not clean.sum():
        return Model(np.full(len(both), -DRIFT, np.float32), 1.0)
    share = both / both.sum()
    n = [clean.sum(), toxic.sum()]
    delta = np.log((toxic + PRIOR * n[1] * share + 1e-9) / n[1]) - np.log((clean + PRIOR * n[0] * share + 1e-9) / n[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(c > 0, c * np.log(c / np.maximum(both * (k / sum(n)), 1e-9)), 0.0) for c, k in zip((clean, toxic), n, strict=True))
    scores = np.where(g >= SIGNIFICANT, np.clip(delta, -LIMIT, LIMIT), 0.0) - DRIFT
    share = clean_words / clean_words.sum()
    low, high = 1e-6, 1.0
    while np.dot(share, np.exp(high * scores)) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if np.dot(share, np.exp(mid * scores)) < 1 else (low, mid)
    return Model(scores.astype(np.float32), high)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of one text, by Ruzzo and Tompa's
    linear-time scan; runs of negative words are passed over in one step."""
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, previous with a smaller left sum
    for k in np.flatnonzero(scores > 0).tolist():
        left, right, first = total[k], total[k + 1], k
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, k + 1, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(f, e, r - l) for l, r, f, e, _ in stack]


def _statistics(model: Model, words: Words, with_spans: bool = False):
    """Statistic of each row, and the significant segments as (row, first, end, score)."""
    scores = model.scores[_bucket(words.hashes)]
    counts = words.counts
    base = -np.log(np.maximum(counts, 1))
    out = base.astype(np.float64)
    spans = []
    rows = np.searchsorted(words.offsets, np.flatnonzero(scores > 0), "right") - 1
    for r in np.unique(rows).tolist():
        a, b = int(words.offsets[r]), int(words.offsets[r + 1])
        found = segments(scores[a:b])
        normal = [model.lam * s + base[r] for _, _, s in found]
        out[r] = sum(x for x in normal if x > 0) or max(normal)
        if with_spans:
            spans += [(r, f, e, x) for (f, e, _), x in zip(found, normal, strict=True) if x > 0]
    return out, spans


def _histogram(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                x, _ = _statistics(model.value, Words(part.column("text"), TERM_WORDS))
                bins = np.clip((x - LOW) // WIDTH, 0, BINS - 1).astype(int)
                np.add.at(counts, (np.asarray(part.column("y")), bins), 1)
        y, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(y, pa.int32()), pa.array(counts[y, b], pa.int64())], names=["bin", "y", "n"])

    return run


def logistic(x: np.ndarray, positive: np.ndarray, total: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(intercept, slope >= 0) by Newton's method on grouped counts, lightly regularised."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        w = total * p * (1 - p) + 1e-12
        g = np.array([(positive - total * p).sum() - ridge * a, ((positive - total * p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Model from ``labels`` (doc_id, y): two passes over the labelled texts."""
    spark = documents.sparkSession
    learned = with_labels(documents, labels)
    sums = learned.select("text", "y").mapInArrow(_count, _SLICE).groupBy("slice").applyInArrow(_add, _SLICE)
    counts = np.zeros((3, SLICES, BUCKETS // SLICES), np.int64)
    for row in sums.collect():  # SLICES rows of a fixed size: 6 MB
        for k, c in enumerate(COUNTS):
            counts[k, row["slice"]] = np.frombuffer(row[c], np.int64)
    model = token_scores(*counts.reshape(3, -1))
    shared = spark.sparkContext.broadcast(model)
    bins = learned.select("text", "y").mapInArrow(_histogram(shared), "bin int, y int, n long").groupBy("bin", "y").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, BINS))
    for row in bins:
        counts[row["y"], row["bin"]] += row["n"]
    if not counts.sum() or not counts.sum(axis=1).all():
        share = counts[1].sum() / counts.sum() if counts.sum() else 0.0
        model.intercept = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    x = LOW + WIDTH * (np.arange(BINS) + 0.5)
    model.intercept, model.slope = logistic(x, counts[1], counts.sum(axis=0))
    return model


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _score(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, found = _statistics(model.value, Words(part.column("text"), TERM_WORDS), True)
                spans: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for r, f, e, s in found:
                    spans[r].append({"first": f, "end": e, "score": s})
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [pa.array(model.value.probability(x), pa.float64()), pa.array(spans, _SPANS)],
                    names=[*columns, "score", "spans"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document's columns), score (0 to 1) and the significant passages as word
    intervals with their normalised scores."""
    rows = as_rows(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(rows, ["row"], "score double, spans array<struct<first:int,end:int,score:double>>")
    return rows.mapInArrow(_score(shared, ["row"]), schema)


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    return train(documents, stored(learning_labels(labels, "toxic", 5, 0), "toxic-labels"))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every document."""
    scored = score(documents.select("doc_id", "text"), fitted(documents, labels))
    return scored.select(
        "row.doc_id", (id_remainder("row.doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def clean_documents(documents: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """``documents`` without those scored ``most`` or more; columns unchanged."""
    return score(documents, fitted(documents, labels)).filter(F.col("score") < most).select("row.*")

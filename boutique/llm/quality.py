"""Operator 1, quality: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by half; together they cover the
whole document. ``FILTERS`` learned filters of ``WIDTH`` bytes run over every position of a
chunk (the input is the byte itself, one-hot, so a filter is a table of 256 weights per
place), are rectified and max-pooled per chunk. The document's features are the mean and the
maximum of the chunks' pooled values; a logistic layer turns them into one probability.

Since the chunks overlap by half, pooling is done once per half chunk and the maximum taken
over neighbouring halves. A filter at a text's end sees zero bytes, whatever text is next in
the batch, in training as in scoring: a score is a function of the text and the model alone.

Learning is by gradient descent (Adam) on the driver, on a bounded sample: at most
``SAMPLE_DOCUMENTS`` labelled documents outside the held-out fold (the smallest digests of
the id, as many of either label as there are, up to half each; one row of an id that
repeats, that of the smallest digest) and of each at most ``SAMPLE_HALVES`` half chunks,
spread evenly over the whole text. Scoring uses every byte of
every text.

Defined cases: null and empty texts have one empty chunk of zero bytes and get a score like
all others; without both labels every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import column_bytes, slices
from boutique.llm.frames import as_rows, id_remainder, learning_labels, schema_with, stored, with_labels

CHUNK, WIDTH, FILTERS = 512, 5, 12
HALF = CHUNK // 2
SAMPLE_DOCUMENTS, SAMPLE_HALVES = 3000, 16
EPOCHS, BATCH, RATE = 14, 32, 0.01


@dataclass
class Model:
    filters: np.ndarray  # (WIDTH, 256, FILTERS) float32
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,)
    intercept: float


def _activations(buf: np.ndarray, model: Model) -> np.ndarray:
    """Rectified filter outputs at every position of ``buf`` but the last WIDTH - 1."""
    n = len(buf) - WIDTH + 1
    out = model.filters[0][buf[:n]]
    for j in range(1, WIDTH):
        out += model.filters[j][buf[j:j + n]]
    out += model.bias
    return np.maximum(out, 0, out=out)


def padded(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with WIDTH - 1 zero bytes after each: text r begins at offsets[r] + r * (WIDTH - 1)."""
    out = np.zeros(len(buf) + (len(offsets) - 1) * (WIDTH - 1), np.uint8)
    at = np.arange(len(buf)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * (WIDTH - 1)
    out[at] = buf
    return out


def halves(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, offsets by row) of the half chunks: at least one per row."""
    sizes = np.diff(offsets)
    n = np.maximum(-(-sizes // HALF), 1)
    by_row = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(by_row[-1]) - np.repeat(by_row[:-1], n)
    return np.repeat(offsets[:-1], n) + HALF * place, by_row


def pooled(buf: np.ndarray, offsets: np.ndarray, model: Model, piece: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Max-pooled features of every half chunk of the rows. Filters run over pieces of about
    ``piece`` bytes, each with the bytes that its last filters still see."""
    starts, by_row = halves(offsets)
    n = np.diff(by_row)
    ends = np.minimum(starts + HALF, np.repeat(offsets[1:], n))
    shift = np.repeat(np.arange(len(offsets) - 1), n) * (WIDTH - 1)
    data = padded(buf, offsets)
    starts, ends = starts + shift, ends + shift
    out = np.zeros((len(starts), FILTERS), np.float32)
    full = np.flatnonzero(ends > starts)
    lot = (starts[full] // piece) if len(full) else np.zeros(0, int)
    cuts = np.flatnonzero(np.diff(lot, prepend=-1))
    for a, b in zip(cuts, np.append(cuts, len(full))[1:], strict=True):
        s, e = starts[full[a:b]], ends[full[a:b]]
        values = _activations(data[s[0]:e[-1] + WIDTH - 1], model)
        gaps = np.flatnonzero(s[1:] > e[:-1])  # padding between texts: no filter's place
        for k in range(WIDTH - 1):
            values[e[gaps] + k - s[0]] = -1
        out[full[a:b]] = np.maximum.reduceat(values, s - s[0], axis=0)
    empty = np.flatnonzero(ends <= starts)
    if len(empty):
        out[empty] = _activations(np.zeros(WIDTH, np.uint8), model)
    return out, by_row


def features(halved: np.ndarray, by_row: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks (pairs of neighbouring halves) of each row."""
    n = np.diff(by_row)
    chunk = halved.copy()
    last = np.zeros(len(halved), bool)
    last[by_row[1:] - 1] = True
    inner = np.flatnonzero(~last)
    chunk[inner] = np.maximum(halved[inner], halved[inner + 1])
    drop = last & (np.repeat(n, n) > 1)  # the last half belongs to the chunk before it
    chunks = np.where(drop[:, None], 0, chunk)
    count = np.maximum(n - 1, 1)[:, None]
    return np.concatenate([np.add.reduceat(chunks, by_row[:-1], axis=0) / count, np.maximum.reduceat(chunks, by_row[:-1], axis=0)], axis=1)


def probabilities(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    x = features(*pooled(buf, offsets, model)).astype(np.float64)
    total = (x * model.weights).sum(axis=1)  # row by row: not a matrix product, whose rounding depends on the batch
    return 1 / (1 + np.exp(-np.clip(total + model.intercept, -50, 50)))


def _sampled_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most SAMPLE_HALVES half chunks of each text, evenly spread, with the bytes that
    their last filters see beyond them."""
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offsets = column_bytes(part.column("text"))
            taken = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = max(1, -(-(b - a) // HALF))
                picks = range(n) if n <= SAMPLE_HALVES else np.linspace(0, n - 1, SAMPLE_HALVES).astype(int).tolist()
                taken.append([buf[a + HALF * k:min(b, a + HALF * (k + 1) + WIDTH - 1)].tobytes() for k in picks])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "digest")), pa.array(taken, pa.list_(pa.binary()))],
                                             names=["doc_id", "y", "digest", "halves"])


def _gradient_step(model: Model, texts: list[list[bytes]], y: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the weighted logistic loss over a few documents."""
    parts = [h for t in texts for h in t]
    own = np.array([min(max(len(h), 1), HALF) for h in parts])  # positions; what a half has beyond them is only seen
    sizes = own + WIDTH - 1
    buf = np.frombuffer(b"".join(h.ljust(n, b"\0") for h, n in zip(parts, sizes.tolist(), strict=True)), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    by_row = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    values = np.concatenate([_activations(buf, model), np.zeros((WIDTH - 1, FILTERS), np.float32)])
    for k in range(WIDTH - 1):
        values[starts + own + k] = -1
    halved = np.maximum.reduceat(values, starts, axis=0)
    # Position of each half's maximum, per filter.
    where = np.arange(len(buf))[:, None]
    at_top = np.minimum.reduceat(np.where(values == np.repeat(halved, sizes, axis=0), where, len(buf)), starts, axis=0)
    x = features(halved, by_row)
    p = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.intercept, -50, 50)))
    d = weight * (p - y) / weight.sum()
    g_weights, g_intercept = x.T @ d, d.sum()
    dx = d[:, None] * model.weights[None, :]
    # Back through mean and maximum over chunks, then to the half that holds the maximum.
    rows = np.repeat(np.arange(len(texts)), np.diff(by_row))
    n = np.diff(by_row)
    last = np.zeros(len(parts), bool)
    last[by_row[1:] - 1] = True
    nxt = np.where(last, np.arange(len(parts)), np.minimum(np.arange(len(parts)) + 1, len(parts) - 1))
    source = np.where(halved >= halved[nxt], np.arange(len(parts))[:, None], nxt[:, None])
    chunk = np.maximum(halved, halved[nxt])
    used = ~(last & (n[rows] > 1))
    d_chunk = np.where(used[:, None], dx[rows, :FILTERS] / np.maximum(n[rows] - 1, 1)[:, None], 0.0)
    top = np.maximum.reduceat(np.where(used[:, None], chunk, -1), by_row[:-1], axis=0)
    is_top = used[:, None] & (chunk == top[rows])
    d_chunk += np.where(is_top, dx[rows, FILTERS:], 0.0)
    mine = source == np.arange(len(parts))[:, None]
    d_half = np.where(mine, d_chunk, 0.0)
    d_half[1:] += np.where(mine[:-1], 0.0, d_chunk[:-1])
    d_half *= halved > 0
    g_filters = np.stack([np.bincount((buf[at_top + j].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), d_half.ravel(), 256 * FILTERS)
                          for j in range(WIDTH)]).reshape(WIDTH, 256, FILTERS)
    loss = -float((weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum())
    return [g_filters, d_half.sum(axis=0), g_weights, np.array(g_intercept)], loss


def fit(texts: list[list[bytes]], y: np.ndarray, seed: int = 5) -> Model:
    """Train on sampled half chunks. Both labels weigh a half in the filters' training; the
    final layer is then refitted with the true shares."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS), 0.0)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
        model.weights[:] = 0
        model.intercept = float(np.log(share / (1 - share)))
        return model
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    m1, m2, step = None, None, 0
    epochs = int(np.clip(EPOCHS * 1500 / len(y), EPOCHS, 8 * EPOCHS))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            picks = order[k:k + BATCH]
            grads, _ = _gradient_step(model, [texts[i] for i in picks], y[picks], weight[picks])
            params = [model.filters, model.bias, model.weights, np.array(model.intercept)]
            grads[0] += 1e-5 * model.filters
            grads[2] += 1e-4 * model.weights
            m1 = [0.9 * a + 0.1 * g for a, g in zip(m1, grads, strict=True)] if m1 else [0.1 * g for g in grads]
            m2 = [0.99 * a + 0.01 * g * g for a, g in zip(m2, grads, strict=True)] if m2 else [0.01 * g * g for g in grads]
            step += 1
            new = [p - rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8) for p, a, b in zip(params, m1, m2, strict=True)]
            model.filters, model.bias = new[0].astype(np.float32), new[1].astype(np.float32)
            model.weights, model.intercept = new[2], float(new[3])
    return model


def _shift_to_shares(model: Model, sampled: np.ndarray, shares: tuple[float, float]) -> Model:
    """Prior correction of the intercept: from equal weights to the labels' true shares."""
    if all(s > 0 for s in shares) and sampled.min() < sampled.max():
        model.intercept += float(np.log(shares[1] / shares[0]))
    return model


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> Model:
    """Model from ``labels`` (doc_id, y)."""
    n = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    total = sum(n.values())
    rare = min(n.get(0, 0), n.get(1, 0), most // 2)
    digest = F.md5(F.col("doc_id").cast("string"))
    picked = None
    for y in (0, 1):
        room = min(n.get(y, 0), most - rare) if n.get(y, 0) > most // 2 else n.get(y, 0)
        own = labels.filter(F.col("y") == y).orderBy(digest, "doc_id").limit(max(room, 0))
        picked = own if picked is None else picked.unionByName(own)
    sample = with_labels(documents, stored(picked, "quality-sample")).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    sample = sample.mapInArrow(_sampled_halves, "doc_id long, y int, digest string, halves array<binary>")
    once = sample.groupBy("doc_id").agg(F.min_by(F.struct("y", "halves"), "digest").alias("s"))
    rows = once.select("s.*").collect()  # at most `most` rows of SAMPLE_HALVES * HALF bytes
    rows.sort(key=lambda r: (r["y"], r["halves"]))
    y = np.array([r["y"] for r in rows], np.int64)
    model = fit([[bytes(h) for h in r["halves"]] for r in rows], y)
    return _shift_to_shares(model, y, (n.get(0, 0) / total, n.get(1, 0) / total)) if total and len(y) else model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = probabilities(*column_bytes(part.column("text")), model.value)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(p, pa.float64())], names=["row", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``row`` (the document's columns) and its score."""
    rows = as_rows(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), schema_with(rows, ["row"], "score double"))


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    learned = stored(learning_labels(labels, "quality", 3, 1), "quality-labels")
    scored = score(documents.select("doc_id", "text"), train(documents, learned))
    return scored.select("row.doc_id", (id_remainder("row.doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

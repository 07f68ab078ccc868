"""Operator 2, exact top-k search by inner product: a KD-tree per shard.

Vectors are quantised to floor(scale * x). Every task cuts its rows into shards of at most
``SHARD`` vectors of one length and builds a KD-tree for each: median splits on the widest
side, a tight bounding box at every node. The shards are stored in the shared folder, one
row each.

A query visits a tree best first. The largest inner product a box allows is
sum(max(q * low, q * high)); a node is left out if that is below the query's k-th best score
so far. That threshold is propagated: a first pass over a few shards gives every query a
k-th score that all other shards start from. All queries of a block go through a tree
together, with one bound and one threshold each.

Queries are a stated set, used in blocks of ``QUERY_BLOCK`` rows and ``QUERY_VALUES``
components at most: one block is broadcast at a time, and every block scans all shards. The
result has k rows per query.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; vectors of different lengths never meet; candidates are rows: an id's several vectors,
and repeated rows, count one by one, but rows with the query's own id are not its candidates;
a query id with several rows is a query for each; ties go to the smaller id; a null id takes
no part. Products are exact; scaled components and scores beyond 64 bits count as the
largest (or smallest) 64-bit integer.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutique.llm.frames import stored

SHARD, LEAF = 8192, 256
QUERY_BLOCK, QUERY_VALUES = 16_384, 1 << 22
#: Shards of the first pass, which sets the thresholds.
PILOT_SHARDS = 1
_LOWEST = -(1 << 63)


@dataclass
class Tree:
    """Nodes in preorder; a leaf holds rows first..end of the reordered vectors."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: np.ndarray  # (nodes, 2), -1 at leaves
    spans: np.ndarray  # (nodes, 2)


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(ids))
    low, high, children, spans = [], [], [], []

    def node(a: int, b: int) -> int:
        own = vectors[order[a:b]]
        k = len(low)
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        children.append((-1, -1))
        spans.append((a, b))
        width = high[k].astype(np.float64) - low[k]
        if b - a > leaf and width.max() > 0:
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int(width.argmax())], middle)]
            left = node(a, a + middle)
            children[k] = (left, node(a + middle, b))
        return k

    node(0, len(ids))
    return Tree(ids[order], vectors[order], np.array(low), np.array(high), np.array(children), np.array(spans))


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max())))


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where all sums stay below 2**53."""
    if not len(vectors) or not len(queries):
        return np.zeros((len(queries), len(vectors)), np.int64)
    largest = _largest(queries) * _largest(vectors) * vectors.shape[1]
    if largest < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if largest < 1 << 63:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, _LOWEST + 1, (1 << 63) - 1).astype(np.int64)


def _bounds(tree: Tree, queries: np.ndarray, node: int) -> np.ndarray:
    """The largest score the node's box allows, by query; a little above, never below
    (the terms may cancel, so the margin follows their sizes, not their sum)."""
    positive, negative = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    high, low = tree.high[node].astype(np.float64), tree.low[node].astype(np.float64)
    return positive @ high + negative @ low + (positive @ np.abs(high) - negative @ np.abs(low)) * 1e-11 + 1


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, scores) of each query's best k in the tree among those that reach
    its threshold. Best first: the open node of the largest bound of any query goes next,
    with the queries that it can still improve."""
    n = len(queries)
    scores = np.full((n, k), _LOWEST, np.int64)
    ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)
    kth = threshold.copy()
    everyone = np.arange(n)
    bound = _bounds(tree, queries, 0)
    heap = [(-float(bound.max(initial=-np.inf)), 0, everyone, bound)]
    while heap:
        _, node, rows, bound = heapq.heappop(heap)
        alive = bound >= kth[rows]
        rows = rows[alive]
        if not len(rows):
            continue
        left, right = tree.children[node]
        if left >= 0:
            for child in (int(left), int(right)):
                b = _bounds(tree, queries[rows], child)
                keep = b >= kth[rows]
                if keep.any():
                    heapq.heappush(heap, (-float(b[keep].max()), child, rows[keep], b[keep]))
            continue
        a, b = tree.spans[node]
        own_ids = tree.ids[a:b]
        found = _products(queries[rows], tree.vectors[a:b])
        found[query_ids[rows][:, None] == own_ids[None, :]] = _LOWEST
        both_s = np.concatenate([scores[rows], found], axis=1)
        both_i = np.concatenate([ids[rows], np.where(found == _LOWEST, np.iinfo(np.int64).max, own_ids[None, :])], axis=1)
        order = np.lexsort((both_i, ~both_s), axis=1)[:, :k]  # ~x descends as x ascends, without overflow
        scores[rows] = np.take_along_axis(both_s, order, axis=1)
        ids[rows] = np.take_along_axis(both_i, order, axis=1)
        kth[rows] = np.maximum(kth[rows], scores[rows, k - 1])
    q, c = np.nonzero((scores > _LOWEST) & (scores >= threshold[:, None]))
    return q, ids[q, c], scores[q, c]


def _build_shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            vectors = batch.column("vector")
            flat, offsets = np.asarray(vectors.values), np.asarray(vectors.offsets)
            for vec_id, a, b in zip(batch.column("vec_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = held.setdefault(b - a, [])
                own.append((vec_id, flat[a:b].astype(np.int64)))
                if len(own) >= size:
                    yield _shard(held.pop(b - a))
        for own in held.values():
            yield _shard(own)

    return run


def _shard(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    tree = build(np.array([i for i, _ in rows], np.int64), np.stack([v for _, v in rows]))
    small = np.int32 if max(abs(int(tree.low.min())), abs(int(tree.high.max()))) < 1 << 31 else np.int64
    tree.vectors = tree.vectors.astype(small)
    return pa.RecordBatch.from_pydict({
        "dimension": pa.array([tree.vectors.shape[1]], pa.int32()), "first_id": [int(tree.ids.min())], "n": [len(rows)],
        "tree": [pickle.dumps(tree, protocol=5)]},
        schema=pa.schema([("dimension", pa.int32()), ("first_id", pa.int64()), ("n", pa.int64()), ("tree", pa.binary())]))


def quantised(vectors: DataFrame, scale: float = 256.0, column: str = "embedding") -> DataFrame:
    """(vec_id, vector): the usable rows as integers."""
    scaled = F.transform(F.col(column), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    usable = F.col("vec_id").isNotNull() & (F.size(column) > 0) & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", column).filter(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), scaled.cast("array<bigint>").alias("vector"))


def index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """The stored shards of (vec_id, vector): dimension, first_id, n, tree; the rows of a
    task, as they come, fill one shard after the other."""
    return stored(vectors.mapInArrow(_build_shards(shard), "dimension int, first_id long, n long, tree binary"), "kd-shards")


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = shared.value
        for batch in batches:
            for dimension, raw in zip(batch.column("dimension").to_pylist(), batch.column("tree"), strict=True):
                if dimension not in blocks:
                    continue
                ids, queries, threshold = blocks[dimension]
                q, found, scores = search(pickle.loads(raw.as_buffer()), ids, queries, threshold, k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(q), dimension), pa.int32()), pa.array(q, pa.int32()), pa.array(ids[q], pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())],
                    names=["dimension", "place", "query_id", "vec_id", "score"])

    return run


_FOUND = "dimension int, place int, query_id long, vec_id long, score long"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dimension", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, shards: DataFrame, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each row of ``queries`` by (score,
    smaller id) among the rows of ``shards`` (see :func:`index`) with another id."""
    spark = queries.sparkSession
    asked = stored(queries.select("vec_id", "vector").withColumn("tie", F.monotonically_increasing_id()), "kd-queries")
    n, values = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    n_blocks = max(1, -(-n // block), -(-values // QUERY_VALUES))
    pilots = shards.orderBy("first_id").limit(PILOT_SHARDS)
    results = None
    for number in range(n_blocks):
        own = asked.filter(F.pmod(F.xxhash64("tie"), F.lit(n_blocks)) == number) if n_blocks > 1 else asked
        rows: dict[int, list] = {}
        for r in own.select("vec_id", "vector").collect():  # one block
            rows.setdefault(len(r["vector"]), []).append((r["vec_id"], r["vector"]))
        blocks = {}
        for dimension, own_rows in rows.items():
            own_rows.sort()
            ids = np.array([i for i, _ in own_rows], np.int64)
            blocks[dimension] = (ids, np.array([v for _, v in own_rows], np.int64), np.full(len(ids), _LOWEST, np.int64))
        first = spark.sparkContext.broadcast(blocks)
        for r in _best(pilots.mapInArrow(_search(first, k), _FOUND), k).filter(F.col("rank") == k).collect():  # a row per query
            blocks[r["dimension"]][2][r["place"]] = r["score"]
        tightened = spark.sparkContext.broadcast({d: (i, v, t.copy()) for d, (i, v, t) in blocks.items()})
        found = _best(shards.mapInArrow(_search(tightened, k), _FOUND), k)
        found = stored(found, "kd-found") if n_blocks > 1 else found
        results = found if results is None else results.unionByName(found)
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Operator 12, near-duplicate embeddings by collision-counting projections.

Vectors link if their cosine is at least ``NEAR``; unit vectors of such a pair are at most
``reach`` = sqrt(2 - 2 NEAR) apart, so on a Gaussian direction they differ by a normal
number of deviation ``reach`` or less, while unrelated ones differ by about sqrt(2) of it.

1. **Projections.** Every distinct vector is projected on many random directions.
2. **Dealing.** A table takes some directions, cuts each into shifted cells and brings
   together the vectors that share all of them; there are as many tables as leave a pair at
   ``NEAR`` apart in all of them with probability ``MISS`` at most. The directions of a table
   grow with log N, so that a task compares a vector with some hundred others at every N.
3. **Counting.** Within a bucket every one of ``COUNTED`` further projections is sorted; a
   pair collides where one value lies in the window around the other. Pairs that collide
   ``least`` times go on: the largest count that a pair at ``NEAR`` misses with probability
   ``MISS`` at most (a binomial tail).
4. **Verifying.** Only members of such pairs are joined to their vectors, and their cosines
   are computed in double precision. A pair is judged in the first table that it shares.

A large bucket is dealt to parts, and a task takes two of them, so no task holds more than
two parts' members. Tasks give back a row per member (its links, one step towards the
smallest member that it is connected with), never a row per pair: a cluster of n mutual
copies makes n rows a table, not n * n. Equal vectors are one node with a weight from the
start. Components are found in rounds over stored tables.

Recall at a cosine of exactly ``NEAR`` is (1 - MISS)**2 by construction, more above it;
nothing below ``NEAR`` is ever linked. Counting looks at all pairs of a bucket: where a
dense cluster is not split by the cells, that is the square of its size, in tasks of bounded
size. An exact number of links needs as much.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing (they are kept); vectors of different lengths never link; equal vectors link
whatever their ids; rows that repeat an id are vectors of their own; a null id never names a
component that has others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import mix
from boutique.llm.frames import stored
from boutique.llm.near_dups import components
from boutique.llm.numbering import small

NEAR = 0.95
#: Chance to miss a pair at NEAR, once for the tables and once for the count.
MISS = 1e-4
#: Width of a cell, and half width of a window, in deviations of a pair at NEAR.
CELL, WINDOW = 4.0, 1.5
COUNTED = 32
#: Unrelated vectors that a vector should meet in a bucket.
MATES = 300
#: Members of a part; a task takes two parts at a time.
TILE = 1024
#: Steps of a projection's unit (values are kept as 16-bit numbers).
_STEPS = 4096
SEED = 12


def _same_cell(width: float) -> float:
    """Probability that a shifted cell of ``width`` deviations holds both of a pair."""
    tail = math.erfc(width / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


@dataclass(frozen=True)
class Calibration:
    reach: float  # distance of a pair at the threshold
    per_table: int  # directions of a table
    tables: int
    least: int  # collisions that a pair must have

    @property
    def window(self) -> int:
        return math.ceil(WINDOW * self.reach * _STEPS) + 1


def calibrate(n: int, near: float = NEAR, miss: float = MISS) -> Calibration:
    reach = math.sqrt(2 - 2 * near)
    together, apart = _same_cell(CELL), _same_cell(CELL * reach / math.sqrt(2))
    per_table = max(1, min(24, round(math.log(max(n, 1) / MATES) / -math.log(apart)))) if n > MATES else 1
    tables = math.ceil(math.log(miss) / math.log(1 - together**per_table))
    p = math.erf(WINDOW / math.sqrt(2))
    least, below = 0, 0.0
    while True:  # below: chance of fewer than least + 1 collisions
        below += math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)
        if below > miss:
            return Calibration(reach, per_table, tables, least)
        least += 1


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that nothing overflows."""
    scaled = vectors.astype(np.float64)
    scaled /= np.abs(scaled).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a list column, one pair for each length."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _sketch(plan: Calibration):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.zeros((n, plan.tables), np.uint64)
            values = np.zeros((n, COUNTED), np.int16)
            for rows, vectors in _matrix(batch.column("vector")):
                d = vectors.shape[1]
                rng = np.random.default_rng([SEED, d])
                counted, dealt = rng.standard_normal((d, COUNTED)), rng.standard_normal((d, plan.tables * plan.per_table))
                shift = rng.random(plan.tables * plan.per_table)
                unit = _units(vectors)
                values[rows] = np.clip(np.rint(unit @ counted * _STEPS), -32768, 32767).astype(np.int16)
                cells = np.floor(unit @ dealt / (CELL * plan.reach) + shift).astype(np.int64).view(np.uint64).reshape(len(rows), plan.tables, -1)
                hashed = np.broadcast_to(np.arange(plan.tables, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(d), keys[rows].shape)
                for j in range(plan.per_table):
                    hashed = mix(hashed + cells[:, :, j] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                keys[rows] = hashed
            yield pa.RecordBatch.from_arrays([
                batch.column("node"),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * plan.tables), pa.array(keys.view(np.int64).ravel())),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COUNTED), pa.array(values.ravel()))],
                names=["node", "keys", "projections"])

    return run


def colliding(values: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of rows that lie in each other's windows on ``least`` projections or
    more. Halfway, pairs that can't reach that any more are let go (at the earliest when a
    pair must have collided once)."""
    n, m = values.shape
    values = values.astype(np.int32)
    counts = np.zeros(n * n, np.uint8)
    half = max(m // 2, m - least + 1)
    for j in range(half):
        order = np.argsort(values[:, j], kind="stable")
        line = values[order, j]
        follow = np.searchsorted(line, line + window, "right") - np.arange(n) - 1
        first = np.repeat(np.arange(n), follow)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(follow) - follow, follow)
        x, y = order[first], order[second]
        counts[np.minimum(x, y) * n + np.maximum(x, y)] += 1
    alive = np.flatnonzero(counts >= least - (m - half))
    a, b, seen = alive // n, alive % n, counts[alive].astype(np.int32)
    for j in range(half, m):
        line = values[:, j]
        seen += np.abs(line[a] - line[b]) <= window
        keep = seen >= least - (m - 1 - j)
        a, b, seen = a[keep], b[keep], seen[keep]
    return a, b


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tile, one table for each tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.asarray(batch.column("tile"))
        cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column("tile")[0].as_py() != tile[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(tile: pa.Table, plan: Calibration) -> tuple[np.ndarray, np.ndarray]:
    """Colliding pairs of a tile that no earlier table holds together. Two parts (sides 1 and
    2) are compared with each other only: a part's own pairs have a tile of their own."""
    n = tile.num_rows
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = {c: tile.column(c).combine_chunks() for c in ("side", "band", "keys", "projections")}
    side, band = column["side"].to_numpy(), int(column["band"][0].as_py())
    a, b = colliding(column["projections"].flatten().to_numpy().reshape(n, -1), plan.window, plan.least)
    keys = column["keys"].flatten().to_numpy().reshape(n, -1)
    keep = (side[a] != side[b]) | (side[a] == 0)
    a, b = a[keep], b[keep]
    new = np.ones(len(a), bool)
    for k in range(0, len(a), 1 << 16) if band else ():
        new[k:k + (1 << 16)] = ~(keys[a[k:k + (1 << 16)], :band] == keys[b[k:k + (1 << 16)], :band]).any(axis=1)
    return a[new], b[new]


def _active(plan: Calibration):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            a, b = _pairs(tile, plan)
            if len(a):
                yield from tile.take(pa.array(np.unique(np.concatenate([a, b])))).combine_chunks().to_batches()

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _verify(plan: Calibration, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            a, b = _pairs(tile, plan)
            if not len(a):
                continue
            n = tile.num_rows
            unit = _units(tile.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1))
            linked = np.concatenate([np.einsum("ij,ij->i", unit[a[k:k + 8192]], unit[b[k:k + 8192]]) >= near for k in range(0, len(a), 8192)])
            a, b = a[linked], b[linked]
            node, copies = tile.column("node").to_numpy(), tile.column("copies").to_numpy()
            links = np.zeros(n, np.int64)
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[_roots(n, a, b)[some]])], names=["node", "links", "towards"])

    return run


def usable(column: str):
    value = F.col(column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(value) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def links(nodes: DataFrame, near: float = NEAR, miss: float = MISS) -> DataFrame:
    """(node, links, towards) from (node, vector, copies): what a tile has found for a node,
    the copies it links to and the smallest node there that it is connected with; stored."""
    plan = calibrate(nodes.count(), near, miss)
    sketched = stored(nodes.select("node", "vector").mapInArrow(_sketch(plan), "node long, keys array<long>, projections array<short>"), "projections")
    bands = sketched.select("node", F.posexplode("keys").alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = bands.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / TILE))
    members = members.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    tile = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    # Keys are told apart by 32 bits in a tile; the tile itself by 64.
    short = sketched.select("node", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys"), "projections")
    tiles = members.select("node", "band", tile.alias("tile"), side.alias("side")).join(short, "node")
    active = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _active(plan), "node long, band int, tile long, side int, keys array<int>, projections array<short>")
    active = stored(active, "colliding").join(nodes, "node")
    return stored(active.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _verify(plan, near), "node long, links long, towards long"), "embedding-links")


def near_duplicates(vectors: DataFrame, near: float = NEAR, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = vectors.select("vec_id", F.col(column).alias("vector"))
    nodes = stored(rows.filter(usable("vector")).groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = links(nodes.select("node", "vector", "copies"), near)
    degrees = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("towards").alias("b")))
    ids = nodes.select("node", "first_id")
    named = small(stored(roots.join(ids, "node").groupBy("root").agg(F.min("first_id").alias("component_id")), "components"))
    linked = stored(roots.join(named, "root").join(degrees, "node").select("node", "links", "component_id"), "linked")
    info = nodes.join(linked, "node", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    together = rows.filter(usable("vector")).join(info, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return together.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

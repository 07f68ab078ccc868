r"""Operator 13, a Merkle manifest of a dataset in van Emde Boas layout.

A row's leaf is the SHA-256 (lowercase hex, as everywhere here) of its doc_id, source, lang,
n_chars and text, each written ``-`` if null, else as UTF-8 byte count, ``:`` and value. The
leaves of a source, by doc_id, are reduced three at a time until one digest is left, the
source's root; the sources' roots, null first and then bytewise, likewise give the root.

**Blocks.** A source's leaves are cut into aligned blocks of ``3**HEIGHT``; a block is one
task's work, and its root is a leaf of the next level, which is cut into blocks again: with
N leaves there are log N / log 3**HEIGHT levels, however many rows one source holds. The
sources' roots go the same way. Leaves get their places from one range partitioning of
(source, doc_id), so a source with a third of all rows is spread like all others.

**Layout.** A block's subtree is stored as one array of digests: cut at half its height, the
top part first, then the bottom parts side by side, each part laid out the same way. The
address of a node is found by arithmetic on (depth, index) alone (:func:`addresses`); a
block is built by the recursion, bottom parts first, and a leaf's siblings are read from it
by their addresses.

**Proofs.** A leaf's siblings are those in its own block and, after them, those of its
block's root in the blocks above; every block hands its own path down to its leaves.
Folding a digest with its siblings gives the root that a reader recomputes.

Defined cases: null columns are ``-`` and differ from empty texts; repeated doc_ids and null
ids (first) are leaves of their own, ties by leaf digest; a source of one row is its leaf; an
empty table has no root and gives no rows; other columns, clashing names too, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutique.llm.frames import stored
from boutique.llm.numbering import FEW_ROWS, numbered, small

ARITY = 3
#: Levels that one block reduces: 3**8 = 6,561 leaves, 9,841 digests of 32 bytes at most.
HEIGHT = 8
_WIDTH = 32
#: Blocks (of up to 315 KB) that one task goes through without a shuffle.
FEW_BLOCKS = 256


# ------------------------------------------------------------------------------ layout
def size(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slots of the nodes ``index`` at ``depth`` (root 0) of a complete subtree: the upper
    half of the levels first, then the subtrees below it, each in this same layout."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    below = ARITY ** (depth - top)
    return size(top) + index // below * size(levels - top) + addresses(levels - top, depth - top, index % below)


@lru_cache(maxsize=64)
def slot_table(levels: int) -> list[np.ndarray]:
    return [addresses(levels, d, np.arange(ARITY**d)) for d in range(levels)]


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def build(leaves: list[bytes], levels: int) -> np.ndarray:
    """The subtree over ``leaves`` (at most ``ARITY**(levels - 1)``) as an array of slots;
    slots beyond the leaves stay zero. Built along the layout: every bottom part is done
    before the top part that stands on its root."""
    slots = np.zeros((size(levels), _WIDTH), np.uint8)

    def lay(own: list[bytes], n_levels: int, base: int) -> bytes:
        if n_levels == 1:
            slots[base] = np.frombuffer(own[0], np.uint8)
            return own[0]
        if n_levels == 2:
            root = sha256("".join(x.hex() for x in own).encode()).digest()
            slots[base:base + 1 + len(own)] = np.frombuffer(root + b"".join(own), np.uint8).reshape(-1, _WIDTH)
            return root
        top = n_levels // 2
        below = n_levels - top
        width = ARITY ** (below - 1)
        roots, at = [], base + size(top)
        # A bottom part's root is a leaf of one level above it: hash the runs of its top.
        for first in range(0, len(own), width):
            roots.append(lay(own[first:first + width], below, at))
            at += size(below)
        runs = [sha256("".join(x.hex() for x in roots[k:k + ARITY]).encode()).digest() for k in range(0, len(roots), ARITY)]
        return lay(runs, top, base)

    lay(leaves, levels, 0)
    return slots


def height(n: int) -> int:
    """Reductions until ``n`` nodes are one."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def siblings(slots: np.ndarray, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For each of the ``n`` leaves of a block: per level, from the leaf up, the digests
    before and after it in its run, each joined as hex."""
    paths: list[list[tuple[str, str]]] = [[] for _ in range(n)]
    table = slot_table(levels)
    count, below = n, 1
    for depth in range(levels - 1, 0, -1):
        # The nodes of this depth by their addresses, as hex.
        nodes = [x.tobytes().hex() for x in slots[table[depth][:count]]]
        around = []
        for i in range(count):
            run = i - i % ARITY
            around.append(("".join(nodes[run:i]), "".join(nodes[i + 1:min(run + ARITY, count)])))
        for leaf in range(n):
            paths[leaf].append(around[leaf // below])
        count, below = -(-count // ARITY), below * ARITY
    return paths


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = h(before + digest + after)
    return digest


# ------------------------------------------------------------------------------ leaves
def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars")) -> Column:
    return F.sha2(F.concat(*[encoded(F.col(f"`{c}`")) for c in columns], encoded(text)), 256)


def leaves(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """grp, doc_id, leaf, claimed (what a reader computes from the rows it got; hex): stored."""
    claimed = leaf_digest(F.col("text") if tampered is None else tampered)
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first
    return stored(documents.select(group.alias("grp"), "doc_id", leaf_digest(F.col("text")).alias("leaf"), claimed.alias("claimed")), "leaves")


# ------------------------------------------------------------------------------ building
_BLOCK = "grp string, place long, n int, levels int, last boolean, slots binary, digest string"


def _blocks(up: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One block of a group: its subtree, its root and whether it is the group's only one."""
        grp, block = (k.as_py() for k in key)
        digests = [bytes.fromhex(x) for x in table.sort_by("place").column("digest").to_pylist()]
        alone = table.column("total")[0].as_py() <= ARITY**up
        levels = 1 + (height(len(digests)) if alone else up)
        slots = build(digests, levels)
        return pa.table({
            "grp": [grp], "place": pa.array([block], pa.int64()), "n": pa.array([len(digests)], pa.int32()), "levels": pa.array([levels], pa.int32()),
            "last": [alone], "slots": [slots.tobytes()], "digest": [slots[0].tobytes().hex()]})

    return run


def _block_of(up: int) -> Column:
    return F.floor(F.col("place") / ARITY**up).cast("long")


def few_together(rows: DataFrame, most: int) -> DataFrame:
    """A table of at most ``most`` rows as one partition, which needs no shuffle."""
    return rows.coalesce(1) if rows.limit(most + 1).count() <= most else rows


def trees(placed: DataFrame, name: str, up: int) -> list[DataFrame]:
    """The levels of blocks over (grp, place, digest), lowest first: every group ends in one
    block (``last``), whose digest is the group's root. Stored tables."""
    levels, below = [], placed.select("grp", "place", "digest")
    while True:
        below = few_together(below, FEW_ROWS)
        totals = small(stored(below.groupBy("grp").agg((F.max("place") + 1).alias("total")), f"{name}-totals"))
        made = below.join(totals, "grp").withColumn("block", _block_of(up)).groupBy("grp", "block").applyInArrow(_blocks(up), _BLOCK)
        levels.append(stored(made, f"{name}-blocks"))
        below = levels[-1].filter(~F.col("last")).select("grp", "place", "digest")
        if below.isEmpty():
            return levels


# ------------------------------------------------------------------------------ proofs
_PATH = "grp string, place long, before array<string>, after array<string>, subroot string, root string"


def _paths(block_no: int, nodes: pa.Table, blocks: pa.Table, up: int) -> pa.Table:
    """Paths of the nodes of one block: their siblings in it, then the block's own path."""
    block = blocks.to_pylist()[0]
    slots = np.frombuffer(block["slots"], np.uint8).reshape(-1, _WIDTH)
    paths = siblings(slots, block["n"], block["levels"])
    places = nodes.column("place").to_pylist()
    own = [paths[p - block_no * ARITY**up] for p in places]
    n = len(places)
    return pa.table({
        "grp": nodes.column("grp"), "place": nodes.column("place"),
        "before": pa.array([[b for b, _ in x] + block["before"] for x in own], pa.list_(pa.string())),
        "after": pa.array([[a for _, a in x] + block["after"] for x in own], pa.list_(pa.string())),
        "subroot": pa.array([block["subroot"]] * n, pa.string()), "root": pa.array([block["root"]] * n, pa.string())})


def hand_down(nodes: DataFrame, blocks: DataFrame, up: int) -> DataFrame:
    """Paths (grp, place, before, after, subroot, root) of the nodes below ``blocks``."""

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, above: pa.Table) -> pa.Table:
        return _paths(key[1].as_py(), own, above, up)

    nodes = few_together(nodes.select("grp", "place", _block_of(up).alias("block")), FEW_ROWS)
    return nodes.groupBy("grp", "block").cogroup(few_together(blocks, FEW_BLOCKS).groupBy("grp", "block")).applyInArrow(run, _PATH)


def _blocks_with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.select("grp", F.col("place").alias("block"), "n", "levels", "slots").join(
        paths.withColumnRenamed("place", "block"), ["grp", "block"])


def block_paths(levels: list[DataFrame], tops: DataFrame, name: str, up: int) -> DataFrame:
    """The lowest blocks with what lies above them (before, after, subroot, root). ``tops``:
    (grp, before, after, subroot, root) of every group's root."""
    upper = None
    for blocks in reversed(levels):
        ends = blocks.filter("last").select("grp", "place").join(tops, "grp")
        if upper is not None:
            ends = ends.unionByName(hand_down(blocks.filter(~F.col("last")), upper, up))
        upper = stored(_blocks_with_paths(blocks, ends), f"{name}-paths")
    return upper


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(up: int):
    def run(key: tuple[pa.Scalar, ...], nodes: pa.Table, blocks: pa.Table) -> pa.Table:
        paths = _paths(key[1].as_py(), nodes, blocks, up)
        before, after = paths.column("before").to_pylist(), paths.column("after").to_pylist()
        claimed, root = nodes.column("claimed").to_pylist(), paths.column("root").to_pylist()
        proofs = [h("".join(x + y for x, y in zip(b, a, strict=True))) for b, a in zip(before, after, strict=True)]
        folded = [fold(c, list(zip(b, a, strict=True))) for c, b, a in zip(claimed, before, after, strict=True)]
        return pa.table({
            "doc_id": nodes.column("doc_id"), "leaf": nodes.column("leaf"), "subroot": paths.column("subroot"), "root": paths.column("root"),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([f == r for f, r in zip(folded, root, strict=True)], pa.bool_())})

    return run


def manifest(documents: DataFrame, tampered: Column | None = None, up: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """(placed leaves: grp, place, doc_id, leaf, claimed; lowest blocks with their paths)."""
    rows = leaves(documents, tampered)
    placed = numbered(rows, "grp", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "leaf-order")
    levels = trees(placed.withColumnRenamed("leaf", "digest"), "source", up)
    roots = levels[0].filter("last")
    for blocks in levels[1:]:
        roots = roots.unionByName(blocks.filter("last"))
    roots = stored(roots.select(F.lit("").alias("all"), "grp", "digest"), "subroots")
    ranked = numbered(roots, "all", [F.col("grp")], "source-order").withColumnRenamed("grp", "source_key")
    ranked = stored(ranked.select(F.col("all").alias("grp"), "source_key", "place", "digest"), "sources")
    above = trees(ranked, "dataset", up)
    end = above[-1].filter("last").select(
        "grp", F.array().cast("array<string>").alias("before"), F.array().cast("array<string>").alias("after"),
        F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    upper = block_paths(above, end, "dataset", up)
    down = hand_down(ranked, upper, up)
    tops = stored(down.drop("subroot").join(ranked.select("grp", "place", "source_key", F.col("digest").alias("subroot")), ["grp", "place"])
                  .select(F.col("source_key").alias("grp"), "before", "after", "subroot", "root"), "tops")
    return placed, block_paths(levels, small(tops), "source", up)


def verify(documents: DataFrame, tampered: Column | None = None, up: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row: proofs
    of the rows as given, folded from what ``tampered`` makes of their texts."""
    placed, blocks = manifest(documents, tampered, up)
    nodes = placed.withColumn("block", _block_of(up))
    return nodes.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(_prove(up), _PROOF)

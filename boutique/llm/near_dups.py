"""Operator 5, near-duplicates by Order MinHash, verified by banded alignment.

Texts are compared as sequences of lower-cased words. Two texts are linked if their edit
similarity 1 - distance / longer length, in words, is at least ``SIMILAR``; classes are the
connected components of the links.

1. Equal word sequences (64-bit fingerprint) are one node from the start, so thousands of
   copies cost one node.
2. A node's k-mers (k consecutive words) are labelled with their occurrence number, so
   repeated k-mers count. Each hash function picks the ``PICKED`` smallest labelled k-mers
   and keeps them in text order; they are one key, and nodes sharing a key are a bucket.
   ``FAMILIES`` gives the k and the number of functions: shingles of five words, and shorter
   ones, which survive scattered edits (texts at the threshold, every fifth word replaced,
   share a tenth to a fifth of their five-word shingles, but a third of those of three).
3. Candidates are checked by an alignment in a band around the diagonal, widened while the
   distance exceeds it up to the allowed distance, many pairs at a time.
4. In every bucket the members are compared with its smallest node first. Then all members
   of a bucket that are still in different classes are compared with each other, tile by
   tile, so that large buckets are shared out; pairs whose lengths or word counts rule them
   out aren't aligned, and only links are rows.
5. Components are found by hooking and jumping on the links, with stored tables between the
   rounds. Nothing but counts reaches the driver.

Defined cases: texts without words (null, empty, punctuation) are never duplicates; texts of
fewer than ``K`` words only of equal texts (a fifth of them is less than a word); rows with equal words are copies, whatever their
ids; a class is named after its smallest doc_id (null if it has only null ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import TERM_WORDS, U64, Words, mix, slices, window_hashes
from boutique.llm.frames import as_rows, drop_since, schema_with, scratch_mark, stored
from boutique.llm.numbering import small

#: (k, number of functions) of the sketches; K is the shortest text that has any.
FAMILIES, PICKED = ((5, 12), (3, 24)), 2
K, SIMILAR = 5, 0.8
SKETCHES = sum(n for _, n in FAMILIES)
#: Members of a bucket, and their words, that a member meets at once; larger buckets are
#: compared tile by tile, all of them.
PAIRS_PER_MEMBER, TILE_WORDS = 1024, 1 << 20
#: Bins of the words of a node, a byte each; pairs whose bins differ too much aren't aligned.
BINS = 256
_FACTORS = np.random.default_rng(41).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * U64(2) + U64(1)
_TOP = U64(0xFFFFFFFFFFFFFFFF)
_STEP = U64(0x9E3779B97F4A7C15)


def fingerprints(words: Words) -> np.ndarray:
    """64 bits of each row's word sequence (0 for rows without words)."""
    place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], words.counts)
    spread = mix(words.hashes + place.astype(np.uint64) * _STEP)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    out = mix(total[words.offsets[1:]] - total[words.offsets[:-1]] + words.counts.astype(np.uint64))
    return np.where(words.counts > 0, out, U64(0))


def _labelled(kmers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """k-mer hashes mixed with their occurrence number within the row."""
    if not len(kmers):
        return kmers
    own = mix(kmers ^ mix(rows.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    first = np.flatnonzero(new)
    nth = np.empty(len(kmers), np.uint64)
    nth[order] = (np.arange(len(kmers)) - np.repeat(first, np.diff(np.append(first, len(kmers))))).astype(np.uint64)
    return mix(kmers + nth * _STEP)


def _smallest(g: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each row's smallest value (the first, among equal ones)."""
    at = np.flatnonzero(g == np.repeat(np.minimum.reduceat(g, starts), counts))
    if len(at) > len(starts):
        at = at[np.unique(np.searchsorted(starts, at, "right"), return_index=True)[1]]
    return at


def sketches(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): for each row of K words or more, SKETCHES keys."""
    rows = np.flatnonzero(words.counts >= K)
    keys = np.zeros((len(rows), SKETCHES), np.uint64)
    if not len(rows):
        return rows, keys
    f = 0
    for k, functions in FAMILIES:
        _, kmers = window_hashes(words.hashes, words.offsets, k)
        every = np.maximum(words.counts - k + 1, 0)
        kmers = kmers[np.repeat(words.counts >= K, every)]
        counts = every[rows]
        starts = np.cumsum(counts) - counts
        labelled = _labelled(kmers, np.repeat(rows, counts))
        for f in range(f, f + functions):
            g = labelled * _FACTORS[f]
            places = []
            for _ in range(PICKED):
                places.append(_smallest(g, starts, counts))
                g[places[-1]] = _TOP  # a row of fewer k-mers gives its first one again
            for at in np.sort(np.stack(places), axis=0):
                keys[:, f] = mix(keys[:, f] * U64(3) + labelled[at] + U64(f + 1))
        f += 1
    return rows, keys


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            words = Words(part.column("text"), TERM_WORDS)
            rows, keys = sketches(words)
            width = keys.shape[1]
            has = np.zeros(part.num_rows + 1, np.int64)
            has[rows + 1] = width
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(has), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fingerprints(words).view(np.int64)), pa.array(words.counts, pa.int32()), lists],
                names=["doc_id", "node", "n_words", "keys"])


def _word_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), TERM_WORDS)
            low = (words.hashes & U64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(fingerprints(words).view(np.int64)),
                pa.array([low[a:b].tobytes() for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)], pa.binary())],
                names=["doc_id", "node", "words"])


def _bins(words: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS bins, 255 at most."""
    return np.minimum(np.bincount(words % BINS, minlength=BINS), 255).astype(np.uint8)


def _banded(a: list[np.ndarray], b: list[np.ndarray], t: int) -> np.ndarray:
    """Edit distances within a band of t diagonals to either side; t + 1 or more where the
    distance exceeds t."""
    n, width = len(a), 2 * t + 1
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = int(la.max(initial=0))
    left = np.zeros((n, rows), np.int64)
    right = np.full((n, max(rows, int(lb.max(initial=0))) + width + 1), -1, np.int64)
    for k in range(n):
        left[k, :la[k]] = a[k]
        right[k, t:t + lb[k]] = b[k]
    big = 1 << 28
    step = np.arange(width)
    row = np.broadcast_to(np.where(step >= t, step - t, big), (n, width)).copy()
    out = np.full(n, big)
    end = np.clip(lb - la + t, 0, width - 1)
    inside = np.abs(lb - la) <= t
    done = (la == 0) & inside
    out[done] = row[done, end[done]]
    for i in range(1, rows + 1):
        best = row + (right[:, i - 1:i - 1 + width] != left[:, i - 1:i])
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(best - step, axis=1) + step
        done = (la == i) & inside
        if done.any():
            out[done] = row[done, end[done]]
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset of words."""
    both = np.sort(np.concatenate([a.astype(np.int64) * 2, b.astype(np.int64) * 2 + 1]))
    word, first = np.unique(both >> 1, return_index=True)
    n = np.diff(np.append(first, len(both)))
    from_b = np.add.reduceat(both & 1, first) if len(first) else first
    return int(np.minimum(n - from_b, from_b).sum())


def alike(a: list[np.ndarray], b: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Whether the edit similarity of each pair of word arrays reaches ``similar``."""
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    limit = np.floor((1 - similar) * longer + 1e-9).astype(int)
    out = np.zeros(len(a), bool)
    open_: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if abs(len(x) - len(y)) > limit[k] or longer[k] - _overlap(x, y) > limit[k]:
            continue
        m = min(len(x), len(y))
        differs = np.flatnonzero(x[:m] != y[:m])
        head = int(differs[0]) if len(differs) else m
        x, y = x[head:], y[head:]
        m = min(len(x), len(y))
        differs = np.flatnonzero(x[::-1][:m] != y[::-1][:m])
        tail = int(differs[0]) if len(differs) else m
        open_.append((k, x[:len(x) - tail], y[:len(y) - tail]))
    t = 8
    while open_:
        open_.sort(key=lambda p: len(p[1]))
        again = []
        lot = max(1, 32768 // (2 * t + 1))
        at = 0
        while at < len(open_):
            size = lot
            while size > 1 and size * (len(open_[min(at + size, len(open_)) - 1][1]) + 2 * t) > 2_000_000:
                size //= 2
            part = open_[at:at + size]
            at += size
            distance = _banded([p[1] for p in part], [p[2] for p in part], t)
            for (k, x, y), d in zip(part, distance.tolist(), strict=True):
                if d <= min(t, limit[k]):
                    out[k] = True
                elif d > t and t < limit[k]:
                    again.append((k, x, y))
        open_, t = again, t * 4
    return out


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "right_words", 4 << 20):
                a, b = ([np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in part.column(c)] for c in ("left_words", "right_words"))
                yield part.select(["a", "b"]).filter(pa.array(alike(a, b, similar)))

    return run


def _close_pairs(tile: np.ndarray, side: np.ndarray, root: np.ndarray, n_words: np.ndarray, leads: np.ndarray, band: np.ndarray, keys: np.ndarray,
                 bins: np.ndarray, similar: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of rows) of one tile that aren't of one class, have no earlier key in common
    (they meet there) and aren't ruled out by their lengths or bins: every edit changes at
    most one word of either text, so a text has at most as many words beyond the other's,
    bin by bin, as there are edits."""
    n = len(tile)
    partners = np.searchsorted(tile, tile, "right") - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    sums = bins.sum(axis=1, dtype=np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        a = np.repeat(np.arange(first, last), partners[first:last])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[first:last] - total[first], partners[first:last])
        limit = np.floor((1 - similar) * np.maximum(n_words[a], n_words[b]) + 1e-9)
        keep = (root[a] != root[b]) & ((side[a] == 0) | (side[a] != side[b])) & ~leads[a] & ~leads[b] & (np.abs(n_words[a] - n_words[b]) <= limit)
        a, b, limit = a[keep], b[keep], limit[keep]
        for k in range(0, len(a), 4096):
            x, y = a[k:k + 4096], b[k:k + 4096]
            beyond = np.maximum(bins[x], bins[y]).sum(axis=1, dtype=np.int64) - np.minimum(sums[x], sums[y])
            near = beyond <= limit[k:k + 4096]
            x, y = x[near], y[near]
            here = (keys[x] == keys[y]).argmax(axis=1) == band[x]
            if here.any():
                yield x[here], y[here]
        first = last


def _tile_links(similar: float):
    """Links from rows that come tile by tile; a tile may reach over several batches."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        tile, side, node, root, n_words, leads, band = (rows.column(c).to_numpy() for c in ("tile", "side", "node", "root", "n_words", "leads", "band"))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        words = [np.frombuffer(w, np.uint32) for w in rows.column("words").to_pylist()]
        bins = np.stack([_bins(w) for w in words])
        for x, y in _close_pairs(tile, side, root, n_words.astype(np.int64), leads, band, keys, bins, similar):
            near = alike([words[k].astype(np.int64) for k in x], [words[k].astype(np.int64) for k in y], similar)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[x[near]]), pa.array(node[y[near]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.asarray(batch.column("tile"))
            at = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
            if at or (held and held[-1].column("tile")[-1].as_py() != tile[0]):
                yield from links(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from links(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node of its
    component. Every node hooks to its smallest neighbour, then jumps once; links are
    contracted to the hooks. Nodes are hashes, hence in random order, so chains are short
    and the links run out after about log(nodes) rounds."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        jump = hooks.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        hooks = stored(hooks.join(jump, "up").select("a", F.col("upper").alias("up")), "hooks")
        down = hooks.select(F.col("a").alias("b"), F.col("up").alias("b_up"))
        contracted = links.join(hooks, "a").join(down, "b").filter("up <> b_up").select(
            F.greatest("up", "b_up").alias("a"), F.least("up", "b_up").alias("b")).distinct()
        links = stored(contracted, "links")
        new = hooks.select(F.col("a").alias("node"), F.col("up").alias("root"))
        roots = new if roots is None else compose(roots, new)
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots, "roots")


def compose(roots: DataFrame, later: DataFrame) -> DataFrame:
    """Earlier nodes follow their roots in ``later`` (whose nodes were roots before)."""
    moved = roots.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
    return moved.select("node", F.coalesce("next", "root").alias("root"))


def sketch_documents(documents: DataFrame) -> DataFrame:
    """doc_id, node (fingerprint), n_words, keys of every row; stored."""
    return stored(documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _sketch, "doc_id long, node long, n_words int, keys array<long>"), "sketches")


class _Search:
    """State of one run: nodes, their buckets and word arrays, classes found so far."""

    def __init__(self, documents: DataFrame, sketched: DataFrame, similar: float):
        self.similar = similar
        useful = sketched.filter(F.size("keys") > 0)
        self.nodes = stored(useful.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys")), "nodes")
        bands = self.nodes.select("node", "doc_id", "n_words", F.posexplode("keys").alias("band", "key"))
        shared = bands.groupBy("band", "key").agg(
            F.min("node").alias("leader"), F.min_by("n_words", "node").alias("leader_words"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.members = stored(bands.join(shared, ["band", "key"]).select(
            F.xxhash64("band", "key").alias("bucket"), "band", "node", "doc_id", "n_words", "leader", "leader_words"), "buckets")
        wanted = small(stored(self.members.groupBy("node").agg(F.min("doc_id").alias("own_id")), "wanted"))
        texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
        chosen = texts.join(wanted.select("own_id"), F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")
        arrays = chosen.mapInArrow(_word_arrays, "doc_id long, node long, words binary")
        arrays = arrays.join(wanted, "node").filter(F.col("doc_id").eqNullSafe(F.col("own_id")))
        self.words = stored(arrays.select("node", "words").dropDuplicates(["node"]), "words")

    def close(self, a: str, b: str):
        """Lengths that allow the similarity."""
        return F.least(a, b) >= F.greatest(a, b) * self.similar - 1e-9

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The distinct (a, b), a > b, that are alike by alignment; stored."""
        joined = (pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
                  .join(self.words.select(F.col("node").alias("a"), F.col("words").alias("left_words")), "a")
                  .join(self.words.select(F.col("node").alias("b"), F.col("words").alias("right_words")), "b"))
        return stored(joined.mapInArrow(_verify(self.similar), "a long, b long"), "links")

    def rooted(self, rows: DataFrame, node: str, root: str) -> DataFrame:
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
        return rows.join(roots, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")

    def leaders(self) -> None:
        """Every member against the leaders of its buckets."""
        usable = self.members.filter((F.col("node") != F.col("leader")) & self.close("n_words", "leader_words"))
        self.roots = components(self.verified(usable.select(F.col("node").alias("a"), F.col("leader").alias("b"))))

    def apart(self) -> DataFrame:
        """Links (a, b) between members of one bucket that no leader has brought together:
        all of them are compared. A large bucket's members are dealt to parts by hash; a
        tile is two of its parts, and each pair of members has its tile."""
        members = self.members.select("bucket", "band", "node", "n_words", (F.col("node") == F.col("leader")).alias("leads"))
        level = stored(self.rooted(members, "node", "root"), "level")
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.min("root").alias("low"), F.max("root").alias("high"))
        parts = F.least("n", F.greatest(F.ceil(F.col("n") / max(PAIRS_PER_MEMBER, 1)), F.ceil(F.col("words") / TILE_WORDS)))
        mixed = small(stored(sizes.filter("low <> high").select("bucket", parts.alias("parts")), "mixed"))
        dealt = level.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
        dealt = dealt.join(self.words, "node").join(self.nodes.select("node", "keys"), "node")
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
        tiles = dealt.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), side.alias("side"),
                             "node", "root", "n_words", "leads", "band", "keys", "words")
        return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links(self.similar), "a long, b long")

    def rest(self) -> None:
        """Members of one bucket that no leader has brought together."""
        links = stored(self.apart(), "links")
        if not links.isEmpty():  # links between classes: the classes' own components, then all nodes follow
            between = self.rooted(self.rooted(links, "a", "a_root"), "b", "b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
            later = components(stored(between.filter("a <> b").distinct(), "links"))
            alone = later.join(self.roots, "node", "left_anti")  # roots that no earlier link names
            self.roots = stored(compose(self.roots, later).unionByName(alone), "roots")


def classes(documents: DataFrame, sketched: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, class_id, class_node): for every fingerprint with words, the smallest doc_id of
    its class and the fingerprint of that document; stored, the steps' tables deleted."""
    mark = scratch_mark()
    search = _Search(documents, sketched, similar)
    search.leaders()
    search.rest()
    ids = sketched.filter("n_words > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rooted = stored(search.rooted(ids, "node", "root"), "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "node"))
    joined = rooted.filter("node <> root")
    # Most classes are one node; the roots of the others, and only those, are looked up.
    several = small(stored(joined.select("root").distinct(), "several"))
    lone = rooted.join(several, "root", "left_anti").select("node", F.col("doc_id").alias("class_id"), F.col("node").alias("class_node"))
    grouped = rooted.join(several, "root", "left_semi")
    named = small(stored(grouped.groupBy("root").agg(first.alias("first")).select("root", "first.doc_id", "first.node"), "named"))
    named = named.select("root", F.col("doc_id").alias("class_id"), F.col("node").alias("class_node"))
    out = stored(lone.unionByName(grouped.join(named, "root").select("node", "class_id", "class_node")), "classes")
    drop_since(documents.sparkSession, mark, out)
    return out


def near_duplicates(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), is_first for every row."""
    sketched = sketch_documents(documents)
    found = classes(documents, sketched, similar)
    rows = sketched.select("doc_id", "node", "n_words").join(found, "node", "left")
    class_id = F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("is_first"))


def _row_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            nodes = fingerprints(Words(part.column("text"), TERM_WORDS))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(nodes.view(np.int64))], names=["row", "node"])


def first_documents(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``documents`` with one row of each class: that of the smallest doc_id; rows without
    words all stay. Of rows that repeat an id and words, one stays. Columns unchanged."""
    sketched = sketch_documents(documents)
    found = classes(documents, sketched, similar)
    kept = stored(found.filter("node = class_node").select("node", F.col("class_id").alias("keep_id")), "kept")
    rows = as_rows(documents)
    rows = rows.mapInArrow(_row_nodes, schema_with(rows, ["row"], "node long"))
    worded = rows.filter("node <> 0").join(small(kept), "node").filter(F.col("row.doc_id").eqNullSafe(F.col("keep_id")))
    repeated = stored(sketched.filter("n_words > 0").groupBy("node", "doc_id").count().filter("count > 1")
                      .join(kept, "node").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("node"), "repeated")
    if not repeated.isEmpty():
        again = worded.join(small(repeated), "node", "left_semi").dropDuplicates(["node"])
        worded = worded.join(small(repeated), "node", "left_anti").unionByName(again)
    return worded.select("row").unionByName(rows.filter("node = 0").select("row")).select("row.*")

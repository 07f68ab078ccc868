"""Operator 11, the prefix trie of conversations by range minima over sorted LCPs.

Every conversation is rebuilt (the first h turns of its family's first conversation, then
its own turns after its first h) and becomes a row of turn digests. The rows are sorted;
the LCP of a row is the number of turns that it shares with the row before it.

**Intervals.** The members of a prefix are neighbours in that order: those reached from any
of them without an LCP below its depth. Candidate prefixes are what a row shares with the
row before it, and its whole sequence. Each candidate searches its left and its right
extent by itself, by binary descent in a sparse table of range minima; candidates of equal
extent and depth are one interval. An interval stands for the nodes between its parent's
depth and its own, which have the same members.

**Figures.** Each is a range minimum or a difference of running sums over the interval.
With W(r) the words of row r and X(r) those of the nodes that r is the first to reach,
the words saved below a node of n members, depth d and words P before its last turn are
(sum W - n P) - (sum X + P(LCP of the first member) - P). A node has one leaf per row that
the next one doesn't reach, and one child per candidate that goes on.

**Blocks.** The sorted rows are cut into blocks, one row of arrays each, worked on by
themselves. A prefix that reaches over a block's end is named (block of its first member,
depth): the least LCPs of all blocks (a number per block, broadcast; ``MOST_BLOCKS`` bounds
them) give that name to every block that it covers, every block adds its share, and one
grouping by name completes it. So no group of conversations, however large, meets in a task.

**Long conversations.** Turns get their places from a range partitioning. Beyond ``CHUNK``
turns, a row only holds digests up to the first chunk of turns that no other conversation
has at that place; what follows is in no other conversation, and its nodes come straight
from the turns. So a row has 16 bytes per turn that is shared with another conversation,
rounded up to a chunk.

Defined cases: null roles and texts are empty; turns are sorted by turn (null first), ties
by digest, repeated rows all stay; rows without conv_id belong to no conversation; an absent
family head adds nothing, and c - c%20 goes towards zero; a conversation without turns ends
at the root; an empty table gives no rows. Turns are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutique.llm.frames import stored
from boutique.llm.mixing import word_count
from boutique.llm.numbering import numbered, small

FAMILY, MOST_SHARED = 20, 4
#: Turns by which long conversations are compared at first.
CHUNK = 64
#: Conversations of a block, unless that would make more than MOST_BLOCKS of them.
BLOCK, MOST_BLOCKS = 2048, 1 << 16
_WIDTH = 16
_EMPTY = sha256(b"").hexdigest()


# ------------------------------------------------------------------------------ rebuilding
def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), digest, words of every turn; places for groups of any size."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _WIDTH)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(digest).alias("digest"), word_count(text).alias("words"))
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "turns")
    placed = numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")], "turn-order")
    return placed.select("conv_id", "place", "digest", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, len) and (conv_id, depth from 1, digest, words) of the rebuilt conversations."""
    turns = turns_in_order(conversations)
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).withColumn("head_id", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < MOST_SHARED - 1))
    heads = heads.groupBy(F.col("conv_id").alias("head_id")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))  # 3 at most
    convs = own.join(heads, "head_id", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    given = F.size("head").cast("long")
    convs = stored(convs.select("conv_id", "h", "head", given.alias("given"), (given + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "rebuilt")
    shared = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.digest", "t.words")
    rest = turns.join(convs.select("conv_id", "h", "given"), "conv_id").filter(F.col("place") >= F.col("h")).select(
        "conv_id", (F.col("given") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "words")
    return convs.select("conv_id", "len"), stored(shared.unionByName(rest), "rebuilt-turns")


def capped(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, cap) of conversations whose turns beyond ``cap`` come after a chunk that no
    other conversation has at its place: they are shared with none."""
    long = convs.filter(F.col("len") > CHUNK)
    chunk = F.floor((F.col("depth") - 1) / CHUNK).alias("chunk")
    own = turns.join(long.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", chunk).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("t"))  # a chunk at most
    own = own.select("conv_id", "chunk", F.sha2(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""), 256).alias("content"))
    alone = own.groupBy("chunk", "content").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    caps = alone.groupBy("conv_id").agg(((F.min("chunk") + 1) * CHUNK).alias("cap"))
    return stored(long.join(caps, "conv_id").filter("cap < len").select("conv_id", "cap"), "caps")


# ------------------------------------------------------------------------------ blocks
def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Leading digests that two rows have in common."""
    n = min(len(a), len(b))
    differ = (a[:n] != b[:n]).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def lcps(digests: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before it (0 for the first), depth by depth."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    depth = 0
    while len(open_):
        open_ = open_[(lengths[open_] > depth) & (lengths[open_ - 1] > depth)]
        open_ = open_[(digests[offsets[open_] + depth] == digests[offsets[open_ - 1] + depth]).all(axis=1)]
        depth += 1
        out[open_] = depth
    return out


_BLOCK = ("part int, seq int, n int, first binary, last binary, least long, conv array<long>, len array<long>, total array<long>, "
          "lcp array<int>, kept array<int>, words array<long>")


def _cut(size: int):
    def block(part: int, seq: int, rows: pa.Table) -> pa.RecordBatch:
        digests = rows.column("digests").combine_chunks()
        offsets = np.asarray(digests.offsets).astype(np.int64)
        flat = digests.flatten()
        raw = np.frombuffer(b"".join(flat.to_pylist()), np.uint8).reshape(-1, _WIDTH)
        offsets = offsets - offsets[0]
        lcp = lcps(raw, offsets)
        end = offsets[-2]
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n": pa.array([rows.num_rows], pa.int32()),
            "first": [raw[:offsets[1]].tobytes()], "last": [raw[end:].tobytes()],
            "least": pa.array([int(lcp[1:].min(initial=1 << 40))], pa.int64()),
            "conv": [rows.column("conv_id").to_pylist()], "len": [rows.column("len").to_pylist()], "total": [rows.column("total").to_pylist()],
            "lcp": pa.array([lcp.tolist()], pa.list_(pa.int32())), "kept": pa.array([np.diff(offsets).tolist()], pa.list_(pa.int32())),
            "words": pa.array([rows.column("words").combine_chunks().flatten().to_pylist()], pa.list_(pa.int64()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seq, part = [], 0, 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.column("part")[0].as_py()
                own, batch = batch.slice(0, size - n), batch.slice(size - n)
                held.append(own)
                n += own.num_rows
                if n == size:
                    yield block(part, seq, pa.Table.from_batches(held))
                    held, n, seq = [], 0, seq + 1
        if held:
            yield block(part, seq, pa.Table.from_batches(held))

    return run


def sorted_blocks(convs: DataFrame, turns: DataFrame, caps: DataFrame, size: int | None = None) -> DataFrame:
    """The sorted conversations, cut into blocks; stored."""
    count = convs.count()
    size = size or max(BLOCK, -(-count // MOST_BLOCKS))
    marks = convs.join(caps, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"),
                                                       F.lit(0).cast("long").alias("words"), "len", F.coalesce("cap", "len").alias("cap"))
    limits = small(caps) if not caps.isEmpty() else None
    rows = turns.withColumn("len", F.lit(None).cast("long"))
    rows = rows.join(limits, "conv_id", "left") if limits is not None else rows.withColumn("cap", F.lit(None).cast("long"))
    kept = (F.col("depth") > 0) & (F.col("depth") <= F.coalesce("cap", "depth"))
    rows = rows.unionByName(marks).groupBy("conv_id").agg(
        F.max("len").alias("len"), F.sum("words").alias("total"), F.sort_array(F.collect_list(F.when(kept, F.struct("depth", "digest", "words")))).alias("t"))
    rows = stored(rows.select("conv_id", "len", "total", F.col("t.digest").alias("digests"), F.col("t.words").alias("words")), "sequences")
    ordered = rows.repartitionByRange(max(1, -(-count // size)), "digests", "conv_id").sortWithinPartitions("digests", "conv_id")
    return stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_cut(size), _BLOCK), "trie-blocks")


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = [-1 if a is None else _shared(*(np.frombuffer(x, np.uint8).reshape(-1, _WIDTH) for x in (a, b)))
                  for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "seq", "n", "least")), pa.array(shared, pa.int64())],
                                         names=["part", "seq", "n", "least", "shared"])


# ------------------------------------------------------------------------------ intervals
class SparseTable:
    """Range minima of an array: row k holds the minima of all ranges of length 2**k."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values)]
        while 2 * (1 << (len(self.rows) - 1)) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minima of values[first:end], ranges not empty."""
        out = np.empty(len(first), self.rows[0].dtype)
        level = np.frexp((end - first).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][first[at]], self.rows[k][end[at] - (1 << k)])
        return out

    def left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """From each start, the first row of its run: going left while values are >= depth."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            to = at - (1 << k)
            ok = to >= 0
            ok[ok] = self.rows[k][to[ok] + 1] >= depth[ok]
            at = np.where(ok, to, at)
        return at

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """From each start, the last row of its run."""
        at, n = start.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            to = at + (1 << k)
            ok = to < n
            ok[ok] = self.rows[k][at[ok] + 1] >= depth[ok]
            at = np.where(ok, to, at)
        return at


class Blocks:
    """What all blocks know of each other: number, least LCP (with the row before the
    block), LCP with the row before the block."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["part"], r["seq"]))
        self.number = {(r["part"], r["seq"]): k for k, r in enumerate(rows)}
        self.shared = np.array([r["shared"] for r in rows], np.int64)
        self.least = np.minimum(self.shared, np.array([r["least"] for r in rows], np.int64))

    def home(self, block: int, depth: np.ndarray) -> np.ndarray:
        """Block of the first member of the prefix of so many turns that reaches over the
        start of ``block``: the nearest one to the left with a smaller LCP."""
        if not hasattr(self, "table"):
            self.table = SparseTable(self.least)
        start = np.full(len(depth), block - 1)
        # left() stops at the first row after a value below depth, or on it if it is the start.
        stop = self.table.left(start, depth)
        return stop


_OUT = ("kind int, conv_id long, depth long, parent long, parent_block int, home int, n_convs long, n_children long, n_leaves long, "
        "saved long, ends string, block int, sum_w long, sum_x long, n_ends long, kids long, before_first long, before_last long")
NODE, SHARE, ENDS = 0, 1, 2


def _emit(**columns: np.ndarray | list) -> pa.RecordBatch:
    names = [c.split()[0] for c in _OUT.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _OUT.split(", ")]
    n = len(columns["depth"])
    arrays = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def block_nodes(number: int, blocks: Blocks, conv: np.ndarray, length: np.ndarray, total: np.ndarray, lcp: np.ndarray, kept: np.ndarray,
                words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Nodes that lie within one block, and its share of those that reach over its ends."""
    n = len(conv)
    lcp = lcp.astype(np.int64)
    lcp[0] = blocks.shared[number]
    following = int(blocks.shared[number + 1]) if number + 1 < len(blocks.shared) else -1
    after = np.append(lcp[1:], following)
    begin = np.concatenate([[0], np.cumsum(kept)])
    running = np.concatenate([[0], np.cumsum(words)])

    def said(row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Words of the first so many turns of a row."""
        return running[begin[row] + np.maximum(turns, 0)] - running[begin[row]]

    table, ids, place = SparseTable(lcp), SparseTable(conv), np.arange(n)
    fresh = total - said(place, lcp)
    sums = {c: np.concatenate([[0], np.cumsum(v)]) for c, v in (("w", total), ("x", fresh), ("leaf", after < length))}

    def between(c: str, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return sums[c][last + 1] - sums[c][first]

    # Candidates: what a row shares with the one before, and all that it holds.
    shares = np.flatnonzero(lcp >= 0)
    row = np.concatenate([shares, place])
    depth = np.concatenate([lcp[shares], kept])
    goes_on = np.concatenate([length[shares] > lcp[shares], np.zeros(n, bool)])
    ends = np.concatenate([np.zeros(len(shares), bool), kept == length])
    first, last = table.left(row, depth), table.right(row, depth)
    over_left = (first == 0) & (lcp[0] >= depth)
    over_right = (last == n - 1) & (following >= depth)

    # Within the block.
    inside = np.flatnonzero(~over_left & ~over_right)
    span = int(depth.max(initial=0)) + 1
    name, at, of = np.unique(first[inside] * span + depth[inside], return_index=True, return_inverse=True)
    at = inside[at]
    kids, closing = (np.bincount(of, weights=v[inside], minlength=len(name)).astype(np.int64) for v in (goes_on, ends))
    kids += closing == 0
    lo, hi, deep, some = first[at], last[at], depth[at], row[at]
    top = np.maximum(lcp[lo], after[hi]) + 1
    member = ids.minimum(lo, hi + 1)
    # The parent of the top: the prefix one turn shorter, by its own extents.
    has = top > 0
    up_first, up_last = table.left(lo, top - 1), table.right(lo, top - 1)
    out_left, out_right = has & (up_first == 0) & (lcp[0] >= top - 1), has & (up_last == n - 1) & (following >= top - 1)
    parent = ids.minimum(up_first, up_last + 1)
    parent_block = np.full(len(at), number)
    far = np.flatnonzero(out_left)
    if len(far):
        parent_block[far] = blocks.home(number, top[far] - 1)
    crossing = out_left | out_right
    # One row per node: the depths from the top to the candidate's own.
    many = deep - top + 1
    node = np.repeat(np.arange(len(at)), many)
    d = np.repeat(top, many) + np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
    is_top, is_end = d == top[node], d == deep[node]
    count = hi - lo + 1
    before = said(some[node], d - 1)
    saved = between("w", lo, hi)[node] - count[node] * before - (between("x", lo, hi) + said(some, lcp[lo]))[node] + before
    listed = np.full(len(node), None, object)
    for k, i in zip(np.flatnonzero(is_end & (closing[node] > 0)), np.flatnonzero(closing), strict=True):
        listed[k] = sha256(",".join(map(str, conv[lo[i]:lo[i] + closing[i]].tolist())).encode()).hexdigest()
    outside = is_top & crossing[node]
    yield _emit(
        kind=np.full(len(node), NODE), conv_id=member[node], depth=d,
        parent=pa.array(np.where(is_top, parent[node], member[node]), mask=outside | (d == 0)),
        parent_block=pa.array(parent_block[node], pa.int32(), mask=~outside),
        n_convs=count[node], n_children=np.where(is_end, kids[node], 1), n_leaves=between("leaf", lo, hi)[node], saved=saved, ends=listed.tolist())

    # Over an end of the block: one share per depth that is open there.
    open_left = np.arange(int(lcp[0]) + 1)
    open_right = np.arange(following + 1)
    starts = table.left(np.full(len(open_right), n - 1), open_right)
    begins = ~((starts == 0) & (lcp[0] >= open_right))  # the first member is in this block
    mine = np.flatnonzero(begins)
    deep = np.concatenate([open_left, open_right[mine]])
    if not len(deep):
        return
    lo = np.concatenate([np.zeros(len(open_left), np.int64), starts[mine]])
    hi = np.concatenate([table.right(np.zeros(len(open_left), np.int64), open_left), np.full(len(mine), n - 1)])
    home = np.concatenate([blocks.home(number, open_left) if number else open_left, np.full(len(mine), number)])
    is_first = np.concatenate([np.zeros(len(open_left), bool), np.ones(len(mine), bool)])
    # What its candidates have counted: by side and depth.
    side = np.where(over_left, 0, 1)
    slot = np.concatenate([np.arange(len(open_left)), len(open_left) + np.cumsum(begins) - 1])
    outer = np.flatnonzero(over_left | over_right)
    where = slot[np.where(side[outer] == 0, depth[outer], len(open_left) + depth[outer])]
    kids, closing = (np.bincount(where, weights=v[outer], minlength=len(deep)).astype(np.int64) for v in (goes_on, ends))
    home_of_parent = home.copy()
    shorter = np.maximum(deep - 1, 0)
    if len(mine):
        up = table.left(lo[len(open_left):], shorter[len(open_left):])
        beyond = np.flatnonzero((up == 0) & (lcp[0] >= shorter[len(open_left):]))
        if len(beyond):
            home_of_parent[len(open_left) + beyond] = blocks.home(number, shorter[len(open_left) + beyond])
    yield _emit(
        kind=np.full(len(deep), SHARE), depth=deep, home=home, conv_id=ids.minimum(lo, hi + 1), n_convs=hi - lo + 1,
        parent_block=pa.array(home_of_parent, pa.int32(), mask=~is_first | (deep == 0)),
        n_leaves=between("leaf", lo, hi), sum_w=between("w", lo, hi), sum_x=between("x", lo, hi), kids=kids, n_ends=closing,
        before_first=pa.array(said(lo, lcp[lo]), pa.int64(), mask=~is_first), before_last=pa.array(said(lo, deep - 1), pa.int64(), mask=~is_first))
    some = np.flatnonzero(closing)
    if len(some):
        ending = [np.flatnonzero(length[lo[i]:hi[i] + 1] == deep[i])[:closing[i]] + lo[i] for i in some]
        yield _emit(kind=np.full(len(some), ENDS), depth=deep[some], home=home[some], block=np.full(len(some), number),
                    ends=[",".join(map(str, conv[x].tolist())) for x in ending])


def _nodes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                arrays = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("conv", "len", "total", "lcp", "kept", "words")}
                number = blocks.number[batch.column("part")[k].as_py(), batch.column("seq")[k].as_py()]
                yield from block_nodes(number, blocks, arrays["conv"], arrays["len"], arrays["total"], arrays["lcp"], arrays["kept"].astype(np.int64), arrays["words"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of ids listed in parts, in order: the parts of a node follow each other."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"home": pa.array([node[0]], pa.int32()), "depth": pa.array([node[1]], pa.int64()), "ends": [state.hexdigest()]})

    for batch in batches:
        for home, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("home", "depth", "ends")), strict=True):
            if (home, depth) != node:
                if node is not None:
                    yield done()
                node, state = (home, depth), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield done()


_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations: DataFrame, block: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    caps = capped(convs, turns)
    cut = sorted_blocks(convs, turns, caps, block)
    before = F.lag("last").over(Window.orderBy("part", "seq"))  # a row per block
    edges = cut.select("part", "seq", "n", "least", "first", before.alias("before"))
    known = edges.mapInArrow(_boundaries, "part int, seq int, n int, least long, shared long").collect()  # MOST_BLOCKS rows, or a few more
    shared = spark.sparkContext.broadcast(Blocks(known))
    found = stored(cut.repartition(max(1, len(known)), "part", "seq").mapInArrow(_nodes(shared), _OUT), "trie")

    shares = found.filter(F.col("kind") == SHARE).groupBy("home", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_block").alias("parent_block"), F.max("before_first").alias("before_first"),
        F.max("before_last").alias("before_last"), *[F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "sum_w", "sum_x", "kids", "n_ends")])
    saved = F.col("sum_w") - F.col("n_convs") * F.col("before_last") - F.col("sum_x") - F.col("before_first") + F.col("before_last")
    children = F.col("kids") + F.when(F.col("n_ends") == 0, 1).otherwise(0)
    wide = stored(shares.select("home", "depth", "conv_id", "parent_block", "n_convs", children.alias("n_children"), "n_leaves", saved.alias("saved")), "trie-wide")
    listed = found.filter(F.col("kind") == ENDS).select("home", "depth", "block", "ends")
    listed = listed.repartition("home", "depth").sortWithinPartitions("home", "depth", "block").mapInArrow(_digests, "home int, depth long, ends string")
    parents = small(wide).select(F.col("home").alias("parent_block"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))

    inner = found.filter(F.col("kind") == NODE)
    settled = inner.filter(F.col("parent_block").isNull()).withColumnRenamed("parent", "parent_conv_id")
    pending = inner.filter(F.col("parent_block").isNotNull()).join(parents, ["parent_block", "depth"])
    outer = wide.join(listed, ["home", "depth"], "left")
    outer = outer.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(
        outer.filter("depth > 0").join(parents, ["parent_block", "depth"]))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
               F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256")]
    nodes = settled.select(*columns).unionByName(pending.select(*columns)).unionByName(outer.select(*columns))
    if caps.isEmpty():
        return nodes
    tails = turns.join(small(caps), "conv_id").filter("depth > cap").join(convs, "conv_id")
    at_end = F.col("depth") == F.col("len")
    return nodes.unionByName(tails.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(at_end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256")))

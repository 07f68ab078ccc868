"""Operator 8, substring dedup: repeated windows of words leave every document but the first.

A window is ``size`` consecutive words of one document. A word is removed if some window
that covers it also starts, with the same words, in a document with a smaller id. All
windows are judged on the input.

1. Every task hashes its windows (64-bit Rabin-Karp over word hashes) in runs of
   ``run_windows``. Within a run, windows already seen in a smaller document are settled
   at once; each distinct hash of a run then goes out once, with its smallest document.
   So a passage shared by a third of all documents costs one entry per run, not per copy.
2. The entries travel as compact blocks, one row per (run, bucket of hashes), which keeps
   the shuffle at about 8 bytes per distinct window; each bucket finds the smallest
   document of every hash and answers with the hashes of the documents that repeat it, one
   block per group of documents.
3. Answers and settled windows meet the texts by group of documents (a prime modulus of the
   id), and the windows are merged into maximal removal intervals. The bytes of every group
   are counted first: the rows of a group of more than ``GROUP_BYTES`` (a corpus too large
   for its shuffle partitions, or an id that repeats millions of times) are dealt to parts,
   and each part gets the group's answers.

Defined cases: null or empty texts and texts shorter than a window keep everything; rows
with the same doc_id are one document for the "smaller id" rule (none removes the other);
a null doc_id counts as smaller than all ids, and its rows lose nothing. Windows are
compared by 64-bit hash: among n distinct windows, n*n / 2**65 pairs are expected to
collide by chance (below 0.001 for 10**8 windows, about 0.6 for the 4.6 * 10**9 of 30 GB,
several hundred for 1 TB), each of which may cost up to ``size`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import SPACE_WORDS, U64, Words, column_bytes, covered, slices, window_hashes
from boutique.llm.frames import stored

WINDOW = 13
#: Windows of a run: bounds a task's memory (about 50 bytes each).
RUN_WINDOWS = 2_000_000
#: Text bytes of a group of documents that one task holds.
GROUP_BYTES = 256 << 20
_NO_ID = -(1 << 63)


def pack(values: np.ndarray) -> bytes:
    """Little-endian integers as byte planes, compressed: sorted values share their high
    bytes, so only the differing ones cost space."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


#: Blocks of entries carry a bucket; blocks of answers (group given) pass the buckets by.
_BLOCK = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary())])
_BLOCK_DDL = "bucket int, grp int, hashes binary, docs binary, ids binary"


def _blocks(keys: np.ndarray, hashes: np.ndarray, doc: np.ndarray, ids: np.ndarray, bucket, grp) -> pa.RecordBatch:
    """One block for each run of equal ``keys`` (ascending): its hashes, the documents used
    (``doc`` indexes ``ids``) and each hash's place among those."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    out: dict[str, list] = {k: [] for k in _BLOCK.names}
    for hs, ds in zip(np.split(hashes, cuts[1:]), np.split(doc, cuts[1:]), strict=True):
        used, local = np.unique(ds, return_inverse=True)
        out["hashes"].append(pack(hs))
        out["docs"].append(pack(local.astype(np.uint32)))
        out["ids"].append(pack(ids[used]))
    out["bucket"], out["grp"] = bucket(keys[cuts]), grp(keys[cuts])
    return pa.RecordBatch.from_pydict(out, schema=_BLOCK)


def _unblock(hashes: bytes, docs: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, doc ids) of a block."""
    return unpack(hashes, np.uint64), unpack(ids, np.int64)[unpack(docs, np.uint32)]


def _none(keys: np.ndarray) -> list:
    return [None] * len(keys)


def _answers(hashes: np.ndarray, doc_ids: np.ndarray, groups: int, bucket) -> pa.RecordBatch:
    """Blocks by group of documents of the (hash, document) pairs to give up."""
    grp = doc_ids % groups
    order = np.lexsort((hashes, doc_ids, grp))
    hashes, doc_ids, grp = hashes[order], doc_ids[order], grp[order]
    fresh = np.concatenate([[True], (doc_ids[1:] != doc_ids[:-1]) | (hashes[1:] != hashes[:-1])])
    hashes, doc_ids, grp = hashes[fresh], doc_ids[fresh], grp[fresh]
    ids, doc = np.unique(doc_ids, return_inverse=True)
    return _blocks(grp, hashes, doc, ids, bucket, lambda k: k.astype(np.int32))


def _settle(hashes: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int, groups: int) -> Iterator[pa.RecordBatch]:
    """One run: ``doc`` indexes ``ids``, which ascend. Gives the windows settled within the
    run, by group of documents, and the run's entries, by bucket."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    smallest = d[first][np.cumsum(new) - 1]
    repeat = (d != smallest) & (ids[d] != _NO_ID)
    if repeat.any():
        yield _answers(h[repeat], ids[d[repeat]], groups, lambda k: (buckets + k % buckets).astype(np.int32))
    h, d = h[first], d[first]  # ascending hashes: buckets are hash ranges
    bucket = (((h >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
    yield _blocks(bucket, h, d, ids, lambda k: k.astype(np.int32), _none)


def _windows(size: int, buckets: int, groups: int, run_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sum(len(h) for _, h, _ in held):
                return
            ids, index = np.unique(np.concatenate([i for i, _, _ in held]), return_inverse=True)
            begun = np.cumsum([0, *(len(i) for i, _, _ in held)])
            doc = np.concatenate([index[b + d] for b, (_, _, d) in zip(begun, held, strict=False)])
            yield from _settle(np.concatenate([h for _, h, _ in held]), doc, ids, buckets, groups)

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                words = Words(part.column("text"), SPACE_WORDS)
                first, hashes = window_hashes(words.hashes, words.offsets, size)
                ids = np.asarray(part.column("doc_id").fill_null(_NO_ID), dtype=np.int64)
                rows = np.repeat(np.arange(len(ids)), np.maximum(words.counts - size + 1, 0))
                held.append((ids, hashes, rows))
                if sum(len(h) for _, h, _ in held) >= run_windows:
                    yield from flush()
                    held.clear()
        yield from flush()

    return run


def _answer(groups: int):
    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket: which documents repeat a window of a smaller one. Answers given
        within a run pass through."""
        hashes, ids = [], []
        for batch in group:
            settled = batch.column("grp").is_valid()
            if (keep := batch.filter(settled)).num_rows:
                yield keep
            entries = batch.filter(pc.invert(settled))
            for block in zip(*(entries.column(c).to_pylist() for c in ("hashes", "docs", "ids")), strict=True):
                h, d = _unblock(*block)
                hashes.append(h)
                ids.append(d)
        if not hashes:
            return
        h, d = np.concatenate(hashes), np.concatenate(ids)
        del hashes, ids
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(h))))
        repeat = (d > smallest) & (d != _NO_ID)
        if repeat.any():
            yield _answers(h[repeat], d[repeat], groups, _none)

    return run


def _prime(least: int) -> int:
    return next(n for n in range(max(least, 2), 2 * max(least, 2) + 2) if all(n % k for k in range(2, int(n ** 0.5) + 1)))


def repeated_windows(documents: DataFrame, groups: int, size: int = WINDOW, buckets: int | None = None, run_windows: int = RUN_WINDOWS) -> DataFrame:
    """(grp, hashes, docs, ids): blocks, by group of documents (doc_id modulo ``groups``), of
    the hashes of the windows that documents must give up."""
    buckets = buckets or 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = documents.select("doc_id", "text").mapInArrow(_windows(size, buckets, groups, run_windows), _BLOCK_DDL)
    return entries.groupBy("bucket").applyInArrow(_answer(groups), _BLOCK_DDL).drop("bucket")


_REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,end:int>>, kept string"


def _masks(part: pa.RecordBatch, given: dict[int, np.ndarray], size: int) -> dict[int, np.ndarray]:
    """Masks of removed words, by row, of the rows whose document has ``given`` hashes."""
    doc_ids = part.column("doc_id").to_pylist()
    rows = [r for r, i in enumerate(doc_ids) if i in given]
    words = Words(part.column("text").take(pa.array(rows, pa.int64())), SPACE_WORDS)
    masks = {}
    for k, r in enumerate(rows):
        a, b = int(words.offsets[k]), int(words.offsets[k + 1])
        first, h = window_hashes(words.hashes[a:b], np.array([0, b - a]), size)
        listed = given[doc_ids[r]]
        at = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
        masks[r] = covered(first[listed[at] == h], size, b - a)
    return masks


def _removed(size: int, with_text: bool):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        given: dict[int, np.ndarray] = {}
        if answers.num_rows:
            blocks = [_unblock(*b) for b in zip(*(answers.column(c).to_pylist() for c in ("hashes", "docs", "ids")), strict=True)]
            h, d = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            given = dict(zip(d[cuts].tolist(), np.split(h, cuts[1:]), strict=True))
        spans, kept, n_words, n_removed, digest = [], [], [], [], []
        for batch in documents.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                masks = _masks(part, given, size)
                buf, offsets = column_bytes(part.column("text"))
                for r in range(part.num_rows):
                    words = buf[offsets[r]:offsets[r + 1]].tobytes().split()
                    n_words.append(len(words))
                    gone = masks.get(r)
                    span: list[dict] = []
                    if gone is not None:
                        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        span = [{"first": int(x), "end": int(y)} for x, y in edges]
                        words = list(compress(words, ~gone))
                    spans.append(span)
                    n_removed.append(n_words[-1] - len(words))
                    text = b" ".join(words)
                    kept.append(text if with_text else None)
                    digest.append(hashlib.sha256(text).hexdigest())
        return pa.Table.from_arrays([
            documents.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"])

    return run


def remove_repeats(documents: DataFrame, size: int = WINDOW, buckets: int | None = None,
                   run_windows: int = RUN_WINDOWS, with_text: bool = True) -> DataFrame:
    """Every document with its maximal removal intervals (word positions, end exclusive) and
    the kept words joined by one space (null unless ``with_text``): doc_id, n_words,
    n_removed, kept_sha256, removed, kept."""
    groups = _prime(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = repeated_windows(documents, groups, size, buckets, run_windows)
    by_group = F.coalesce(F.pmod("doc_id", F.lit(groups)), F.pmod(F.xxhash64("text"), F.lit(groups))).cast("int")
    texts = documents.select("doc_id", "text", by_group.alias("grp"))
    sizes = texts.groupBy("grp").agg(F.ceil(F.sum(F.octet_length("text")) / GROUP_BYTES).alias("parts")).filter("parts > 1")
    sizes = stored(sizes, "large-groups")  # a row per group at most
    if sizes.isEmpty():
        return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_removed(size, with_text), _REMOVED)
    parts = F.coalesce("parts", F.lit(1))
    texts = texts.withColumn("n", F.monotonically_increasing_id()).join(F.broadcast(sizes), "grp", "left").select(
        "doc_id", "text", "grp", F.pmod(F.xxhash64("n"), parts).alias("part"))
    answers = answers.join(F.broadcast(sizes), "grp", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return texts.groupBy("grp", "part").cogroup(answers.groupBy("grp", "part")).applyInArrow(_removed(size, with_text), _REMOVED)

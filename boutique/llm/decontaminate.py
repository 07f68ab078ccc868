"""Operator 7, benchmark decontamination: training words inside benchmark passages.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. A window is
``size`` consecutive words of a benchmark item; an item of fewer words is one window. The
windows' hashes are broadcast as sorted arrays; one scan of the documents rolls the same
hashes over their words, and every hash hit is verified word by word.

The broadcast is bounded: ``BLOCK_WINDOWS`` windows at a time (about 200 bytes each with
their texts). A larger benchmark is used in several blocks, one scan each, and the scans
carry the hit words of a document along, so a document is judged on all blocks together.

Defined cases: null or wordless texts have no words and are never contaminated; benchmark
rows without words have no window; rows repeating an item_id are one item; an item without
an id marks words but isn't listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutique.llm.arrays import TERM_WORDS, Words, column_bytes, covered, slices, window_hashes
from boutique.llm.frames import as_rows, schema_with, stored

WINDOW = 13
#: Windows in one broadcast; a benchmark of more is used in blocks.
BLOCK_WINDOWS = 200_000
_FILTER_BITS = 22

_WINDOWS = "item_id string, n int, hash long, words binary"
_STATE = "mask binary, items array<string>"


def _normal(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(TERM_WORDS[buf[s:e]].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), TERM_WORDS)
                out: dict[str, list] = {"item_id": [], "n": [], "hash": [], "words": []}
                for r, item in enumerate(part.column("item_id").to_pylist()):
                    a, b = int(words.offsets[r]), int(words.offsets[r + 1])
                    if a == b:
                        continue
                    n = min(size, b - a)
                    first, h = window_hashes(words.hashes[a:b], np.array([0, b - a]), n)
                    out["item_id"] += [item] * len(first)
                    out["n"] += [n] * len(first)
                    out["hash"] += h.view(np.int64).tolist()
                    out["words"] += [_normal(words.buf, words.starts[a + f:a + f + n], words.ends[a + f:a + f + n]) for f in first.tolist()]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("item_id", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))

    return run


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: n, hash, words, items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(_item_windows(size), _WINDOWS).groupBy("n", "hash", "words").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))


class _Block:
    """Windows of one length: sorted hashes, a bit filter in front, texts and items."""

    def __init__(self, n: int, rows: list):
        rows = sorted(rows, key=lambda r: r["hash"] & (1 << 64) - 1)
        self.n = n
        self.hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        self.texts = [bytes(r["words"]) for r in rows]
        self.items = [list(r["items"]) for r in rows]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, window) of each verified occurrence."""
        first, h = window_hashes(words.hashes, words.offsets, self.n)
        maybe = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        h, first = h[maybe], first[maybe]
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        for f, a, b in zip(first[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
            text = _normal(words.buf, words.starts[f:f + self.n], words.ends[f:f + self.n])
            for k in range(a, b):
                if self.texts[k] == text:
                    yield f, k


def _scan(shared, carried: bool, columns: list[str]):
    """Adds mask (one bit per word, null when clean) and items to the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[_Block] = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), TERM_WORDS)
                n_rows = part.num_rows
                mask = np.zeros(len(words.hashes), bool)
                found: dict[int, set] = {}
                if carried:
                    for r, (m, i) in enumerate(zip(part.column("mask").to_pylist(), part.column("items").to_pylist(), strict=True)):
                        if m is not None:
                            a, b = words.offsets[r], words.offsets[r + 1]
                            mask[a:b] = np.unpackbits(np.frombuffer(m, np.uint8), count=int(b - a)).astype(bool)
                            found[r] = set(i)
                for block in blocks:
                    if hits := list(block.hits(words)):
                        first = np.array([f for f, _ in hits])
                        mask |= covered(np.unique(first), block.n, len(mask))
                        rows = np.searchsorted(words.offsets, first, "right") - 1
                        for r, (_, k) in zip(rows.tolist(), hits, strict=True):
                            found.setdefault(r, set()).update(block.items[k])
                masks = [np.packbits(mask[words.offsets[r]:words.offsets[r + 1]]).tobytes() if r in found else None for r in range(n_rows)]
                items = [sorted(found[r]) if r in found else None for r in range(n_rows)]
                hit = np.concatenate([[0], np.cumsum(mask)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in columns] + [
                        pa.array(words.counts, pa.int64()), pa.array(hit[words.offsets[1:]] - hit[words.offsets[:-1]], pa.int64()),
                        pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    names=[*columns, "n_words", "n_hit", "mask", "items"])

    return run


def _blocks(windows: DataFrame, most: int) -> Iterator[list[_Block]]:
    """The benchmark's windows in blocks of about ``most``, drawn to the driver one block at a time."""
    n = windows.count()
    k = max(1, -(-n // most))
    for b in range(k):
        rows = windows.filter(F.pmod(F.col("hash"), F.lit(k)) == b).collect() if n else []
        yield [_Block(size, [r for r in rows if r["n"] == size]) for size in sorted({r["n"] for r in rows})]


def scan(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``row`` (the document's columns) with n_words, n_hit, mask and items."""
    spark = documents.sparkSession
    rows = as_rows(documents)
    windows = stored(benchmark_windows(benchmark, size), "benchmark-windows")
    state = rows
    for number, blocks in enumerate(_blocks(windows, block_windows)):
        if number:
            state = stored(state.drop("n_words", "n_hit"), "benchmark-hits")
        schema = schema_with(rows, ["row", "text"], f"n_words long, n_hit long, {_STATE}")
        state = state.mapInArrow(_scan(spark.sparkContext.broadcast(blocks), number > 0, ["row", "text"]), schema)
    return state.drop("text")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                  least: float = 0.05) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated (a
    share of ``least`` of its words or more is hit), and the hit word intervals."""
    hits = scan(documents.select("doc_id", "text"), benchmark, size, block_windows)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return hits.select(
        "row.doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated(least).alias("contaminated"), "mask")


def contaminated(least: float = 0.05):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * round(1 / least) >= F.col("n_words"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, least: float = 0.05,
                    block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``documents`` without the contaminated ones, columns unchanged."""
    return scan(documents, benchmark, size, block_windows).filter(~contaminated(least)).select("row.*")


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"), TERM_WORDS, hashed=False)
            buf, offsets = column_bytes(part.column("text"))
            texts = []
            for r, m in enumerate(part.column("mask").to_pylist()):
                a, b = int(words.offsets[r]), int(words.offsets[r + 1])
                text = buf[offsets[r]:offsets[r + 1]]
                if m is not None:
                    gone = np.unpackbits(np.frombuffer(m, np.uint8), count=b - a).astype(np.int8)
                    edges = np.flatnonzero(np.diff(gone, prepend=0, append=0)).reshape(-1, 2)
                    keep = np.ones(len(text), bool)
                    for x, y in edges.tolist():
                        keep[words.starts[a + x] - offsets[r]:words.ends[a + y - 1] - offsets[r]] = False
                    text = text[keep]
                texts.append(text.tobytes() if part.column("text")[r].is_valid else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, text) of every document with the hit passages cut out of its text."""
    hits = scan(documents.select("doc_id", "text"), benchmark, size, block_windows)
    return hits.select("row.doc_id", "row.text", "mask").mapInArrow(_cut_spans, "doc_id long, text string")

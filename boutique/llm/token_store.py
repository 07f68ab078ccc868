"""Operator 4, token IDs in Parquet: list columns, written and read back.

Documents are range-partitioned and sorted by doc_id; each task tokenizes its share and
Spark's Parquet writer stores one row per document: doc_id, place in the file, n_tokens and
the ids. The ids column is a list of 32-bit integers with a dictionary (falling back to
delta encoding where a row group has too many distinct ids, by the v2 page format); row
groups and pages are small and carry a page index, so that readers skip by doc_id and read
n_tokens without the ids. Files are numbered in doc_id order.

Tokenizing: every whole text is encoded; each distinct piece of text is encoded once and
remembered. Pieces end at ASCII white space and between ASCII letters and other ASCII marks,
where the pre-tokenizer cuts anyway, and are lower-cased (A-Z) as its normalizer does.
:func:`piecewise` checks that for the tokenizer; others, and texts that hold one of the
tokenizer's own special strings, are encoded in one go.

Defined cases: null texts are empty (the end id alone); ids are in order of (doc_id, text);
null doc_ids come first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutique.llm.arrays import column_bytes, slices
from boutique.llm.frames import scratch_path, stored

END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Row groups of 16 MB, pages of 64 kB, v2 pages (delta encodings), dictionary for the ids.
WRITER = {
    "compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "1000", "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20), "parquet.writer.version": "v2",
}
#: Pieces a worker remembers (about 150 bytes each), and pieces encoded in one call.
_CACHE_PIECES = 1_200_000
_LOT = 50


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file ``name`` of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: What piecewise encoding relies on: the alternatives of the pre-tokenizer's pattern (a
#: contraction starts with an apostrophe; letters, digits and other marks never mix) ...
_ALTERNATIVES = (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+")
_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK = np.zeros(256, bool)  # ... and the ASCII marks other than space, digits and apostrophe.
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True


def piecewise(spec: dict) -> bool:
    """Whether pieces encode like the whole: the pre-tokenizer drops what its pattern doesn't
    match, the pattern has only the known alternatives, and the normalizer is a lower-casing
    one that doesn't look across pieces."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = [p for p in pre if p.get("type") == "Split"]
    drops = bool(split) and split[0].get("behavior") == "Removed" and split[0].get("invert") and all(
        a in _ALTERNATIVES or (a.startswith("'") and a[1:].isalpha()) for a in split[0]["pattern"].get("Regex", " ").split("|"))
    norm = spec.get("normalizer") or {}
    return bool(drops) and [n.get("type") for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, offsets by row): lower-cased, cut between ASCII letters and marks and at
    ASCII white space. A mark before a letter isn't cut off if it is an apostrophe, which may
    begin a contraction; a letter before one may be."""
    buf, offsets = column_bytes(texts)
    if not len(buf):
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    letter, mark = _LETTER[buf], _MARK[buf]
    cut = np.flatnonzero((letter[:-1] & (mark[1:] | (buf[1:] == 0x27))) | (mark[:-1] & letter[1:])) + 1
    spaced = np.insert(buf, cut, 0x20)
    new_offsets = offsets + np.searchsorted(cut, offsets)  # a cut at a border belongs to the row before it
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer(new_offsets.astype(np.int32)), pa.py_buffer(spaced))
    split = pc.ascii_split_whitespace(pc.ascii_lower(spaced))
    return split.flatten(), np.asarray(split.offsets, dtype=np.int64)


class Encoder:
    """Encodes string columns; ids come as (values, offsets by row), without end ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.piecewise = piecewise(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        marks = [t for t in spec.get("added_tokens", []) if t.get("special") and not t.get("normalized") and not t.get("single_word")]
        self.mark, self.mark_id = (marks[0]["content"], marks[0]["id"]) if marks else (None, -1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate([np.array(ids, np.uint32) for ids in found]) if found else np.zeros(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(sizes)])

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in joined lots, with a special string of the tokenizer's, which it cuts out
        before anything else, between them. (No piece holds one.)"""
        if self.mark is None:
            return self._encode(pieces)
        flat, _ = self._encode([self.mark.join(pieces[k:k + _LOT]) + self.mark for k in range(0, len(pieces), _LOT)])
        marks = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.concatenate([[0], marks - np.arange(len(marks))])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), not self.piecewise)
        for content in self.special:
            whole |= np.asarray(pc.match_substring(texts, content))
        if not whole.any():
            return self._by_pieces(texts)
        parts = [self._encode([t.as_py()]) if w else self._by_pieces(texts.slice(k, 1)) for k, (t, w) in enumerate(zip(texts, whole, strict=True))]
        return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, row_offsets = _pieces(texts)
        coded = pieces.dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = np.asarray(coded.indices)
        sizes = (self.offsets[places + 1] - self.offsets[places]).astype(np.int32)[index]
        ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])  # a slice has few tokens
        take = np.repeat(self.offsets[places].astype(np.int32)[index] - ends[:-1], sizes)
        take += np.arange(ends[-1], dtype=np.int32)
        return self.ids[take], ends[row_offsets - row_offsets[0]].astype(np.int64)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces among the known ones; new ones are encoded and kept.
        (The split leaves empty pieces at the borders of a text; they have no ids.)"""
        if len(self.known) > _CACHE_PIECES:
            self._forget()
        places = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new = [pieces[k] for k in missing.tolist()]
            ids, offsets = self._encode_pieces(new)
            self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            self.ids = np.concatenate([self.ids, ids])
            places[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, places[missing].tolist(), strict=True))
        return places


_encoders: dict[str, Encoder] = {}


def _encode(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        path = name if os.path.isabs(name) else tokenizer_path(name)
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        before = 0
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, offsets = encoder(part.column("text"))
                rows = part.num_rows
                with_end = np.full(len(ids) + rows, end_id, np.uint32)
                keep = np.ones(len(with_end), bool)
                ends = offsets[1:] + np.arange(rows)
                keep[ends] = False
                with_end[keep] = ids
                edges = np.concatenate([[0], ends + 1])
                raw = with_end.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(before + edges[:-1], pa.int64()), pa.array(np.diff(edges), pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(with_end.view(np.int32), pa.int32()))],
                    names=["doc_id", "start_in_file", "n_tokens", "written_crc32", "ids"])
                before += int(edges[-1])

    return run


STORE_SCHEMA = "doc_id long, start_in_file long, n_tokens long, written_crc32 long, ids array<int>"


def write_tokens(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the token store of ``documents`` (doc_id, text) to the folder ``path``. The
    tokenizer's file is named, not shipped: a name of public_tokenizers or a path that
    exists on every executor."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("spread", F.xxhash64("text"))
    ordered = texts.repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").drop("spread")
    ordered.mapInArrow(_encode(tokenizer, end_id), STORE_SCHEMA).write.options(**WRITER).parquet(path)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths and checksums of the ids as read."""
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.asarray(ids.offsets, dtype=np.int64)
        raw = memoryview(np.ascontiguousarray(np.asarray(ids.values).astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("file"), batch.column("start_in_file"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "file", "start_in_file", "n_tokens", "ids_crc32"])


def read_starts(store: DataFrame) -> DataFrame:
    """(file, before): ids in all earlier files, by the number in their names (which Spark
    pads to five digits, so that names don't sort by it); reads n_tokens only."""
    files = store.groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def read_tokens(documents_store: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    read = documents_store.select("doc_id", F.input_file_name().alias("file"), "start_in_file", "ids")
    checked = read.mapInArrow(_check, "doc_id long, file string, start_in_file long, n_tokens long, ids_crc32 long")
    starts = stored(read_starts(documents_store), "token-starts")
    joined = checked.join(starts, "file")
    return joined.select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def tokens_between(store: DataFrame, first_id: int, last_id: int) -> DataFrame:
    """Documents of an id range; the page index lets Parquet skip all other pages."""
    return store.filter(F.col("doc_id").between(first_id, last_id))


def store_documents(documents: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the token store (to ``path``, or a scratch table) and read it back."""
    spark = documents.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(documents, path, tokenizer, end_id)
    return read_tokens(spark.read.schema(STORE_SCHEMA).parquet(path))

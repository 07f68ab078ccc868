"""Whole Arrow string columns as numpy arrays: byte buffers, words and their hashes.

Every word operator works on the bytes of a column at once instead of looping over rows.
A word is a maximal run of bytes that ``table`` maps to a non-zero byte (the mapping also
folds case); document borders end words. UTF-8 makes this exact for classes that treat
all non-ASCII characters alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed in one go; bounds the temporary arrays (about 40 bytes per byte).
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_KEYS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}


def byte_table(separators: bytes = b"", words: bytes | None = None, fold_ascii: bool = False) -> np.ndarray:
    """256-entry map: word byte -> (folded) byte, separator -> 0. Give ``separators``, or
    ``words``: the ASCII word bytes (all bytes from 0x80 on are then word bytes)."""
    table = np.arange(256, dtype=np.uint8)
    if words is None:
        table[list(separators)] = 0
    else:
        ascii_ = np.zeros(128, dtype=bool)
        ascii_[list(words)] = True
        table[:128][~ascii_] = 0
    if fold_ascii:
        upper = slice(0x41, 0x5B)
        table[upper] = np.where(table[upper] > 0, table[upper] + 32, 0)
    return table


#: Words [^\x20\x09-\x0D]+, unchanged. A zero byte is a word byte, hence its own code.
SPACE_WORDS = byte_table(separators=b" \t\n\v\f\r")
SPACE_WORDS[0] = 0x20
#: Lower-cased words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after folding A-Z).
TERM_WORDS = byte_table(
    words=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", fold_ascii=True)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose ``column`` holds about ``most`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    block = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers live on: give the memory back


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 8 * PIECE:
            _powers[key] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection: xor-shift and odd multiplications)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


class Words:
    """Words of a column: ``starts``/``ends`` (byte positions), ``offsets`` (first word of
    each row, one more than rows) and ``hashes`` (64 bits of each word's folded bytes)."""

    def __init__(self, column: pa.Array, table: np.ndarray, hashed: bool = True):
        self.buf, self.byte_offsets = column_bytes(column)
        n = len(self.buf)
        starts, ends, hashes = [], [], []
        borders = self.byte_offsets
        at = 0
        while at < n:
            to = self._cut(min(at + PIECE, n), table)
            folded = table[self.buf[at:to]]
            word = folded != 0
            before = np.empty_like(word)
            before[0] = False
            before[1:] = word[:-1]
            inside = borders[np.searchsorted(borders, at):np.searchsorted(borders, to)] - at
            before[inside] = False
            after = np.empty_like(word)
            after[-1] = False
            after[:-1] = word[1:]
            after[inside[inside > 0] - 1] = False
            s = np.flatnonzero(word & ~before)
            e = np.flatnonzero(word & ~after) + 1
            if hashed:
                values = _BYTE_KEYS[folded]
                values *= _power(_BASE, to - at)[: to - at]
                np.cumsum(values, out=values)
                total = values[e - 1]
                total -= np.where(s > 0, values[s - 1], U64(0))
                hashes.append(mix(total * _power(_BASE_INV, to - at)[s]))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        empty = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.offsets = np.searchsorted(self.starts, self.byte_offsets)

    def _cut(self, to: int, table: np.ndarray) -> int:
        """First position from ``to`` on that no word crosses."""
        n = len(self.buf)
        while to < n:
            k = np.searchsorted(self.byte_offsets, to)
            border = int(self.byte_offsets[k]) if k < len(self.byte_offsets) else n
            look = min(to + 65536, n)
            gaps = np.flatnonzero(table[self.buf[to - 1:look]] == 0)
            gap = to - 1 + int(gaps[0]) + (0 if gaps[0] else 1) if len(gaps) else n
            if min(border, gap) <= look:
                return min(border, gap)
            to = look
        return n

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


_WINDOW_KEYS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def window_hashes(word_hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, 64-bit rolling hash) of every window of ``size`` words within one row."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begun = np.cumsum(counts) - counts
    first = np.arange(total) + np.repeat(offsets[:-1] - begun, counts)
    n = len(word_hashes) - size + 1
    rolled = np.zeros(n, np.uint64)
    base = U64(_BASE)
    for j in range(size):  # Horner's rule on all windows at once
        rolled *= base
        rolled += word_hashes[j:j + n]
    return first, mix(rolled[first] ^ U64(size))


def covered(first: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Mask over ``total`` words of those inside any window starting at ``first``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over the row segments given by ``offsets`` (empty segments give 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Vectorised helpers over the UTF-8 bytes of an Arrow string column: words, word hashes, window hashes.

All of them work on a slice of a batch at a time (`slices`), so memory follows the slice and not the batch.
A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR; words never cross rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 19

WORD_BASE, SECOND_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

#: Words of up to SHORT bytes are hashed as two 64-bit numbers each, under two keys; longer ones by a cryptographic digest.
SHORT, KEYS = 16, (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            tables = []
            for b in (self.base, self.inverse):
                t = np.full(size, b, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t, dtype=np.uint64))
            self.up, self.down = tables
        return self.up[:n], self.down[:n]


_POWERS: dict[int, Powers] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(base, Powers(base)).get(n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a common 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row has a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """The words of some rows: byte starts and ends, and for each row the range of its words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.of_row = np.zeros(len(offsets), np.int64)
            return
        word = ~SEPARATOR[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = True, True
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.of_row = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def digests(self, fold_case: bool = False) -> np.ndarray:
        """Two independent 64-bit hashes of each word, as an array of two columns."""
        if not len(self):
            return np.zeros((0, 2), np.uint64)
        raw = np.concatenate((LOWER[self.data] if fold_case else self.data, np.zeros(SHORT, np.uint8)))
        eight = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))  # the eight bytes from each place on
        size = self.ends - self.starts
        low = eight[self.starts] & _LOW_BYTES[np.minimum(size, 8)]
        high = eight[self.starts + 8] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
        high = high * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        out = np.empty((len(self), 2), np.uint64)
        for column, key in enumerate(KEYS):
            out[:, column] = mix(mix(low + np.uint64(key)) + high)
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = np.frombuffer(blake2b(raw[self.starts[k] : self.ends[k]], digest_size=16).digest(), np.uint64)
        return out

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.digests(fold_case)[:, 0].copy()

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of_row) - 1), np.diff(self.of_row))


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hashes of every `width` consecutive word hashes: window i starts at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n])


def inside(of_row: np.ndarray, width: int) -> np.ndarray:
    """Window starts that keep `width` words inside one row, over rows given by their word ranges."""
    sizes = np.maximum(np.diff(of_row) - width + 1, 0)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(of_row[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    return first + np.arange(total)

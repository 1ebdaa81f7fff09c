"""Vector helpers over Arrow text columns: bytes, words and rolling hashes.

A batch's texts are one UTF-8 byte array and an offset array, so words and
shingles of a whole batch are found by a few numpy passes instead of a Python
loop over documents. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

#: ASCII bytes that separate words: blank and 0x09 to 0x0D.
WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Byte table that lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int):
    """Row ranges of at most ``limit`` bytes (a longer row stands alone)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def slices(batches, column: str, limit: int = 2 << 20):
    """(record batch, bytes, offsets) with bounded text, from an iterator of batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        for a, b in spans(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WORD_BREAKS):
    """(starts, ends, first): byte spans of all words; ``first[i]:first[i+1]`` are those of row i."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place where possible)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        up, self.down = _power(len(data) + 1)
        codes = _CODES if fold is None else _CODES[fold]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive entries of ``h`` (rows are not told apart)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[k : k + n]
    return mix(out)


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and what one stage has freed would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)

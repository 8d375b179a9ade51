"""Vectorised text kernels over Arrow string columns: words, lines and their 64-bit hashes.

A text is its UTF-8 bytes. Words are runs of bytes other than 0x20 and 0x09-0x0D, and A-Z
count as a-z. Nothing here knows of Spark; tasks call it on one Arrow batch at a time.
Hashes are 64 bits wide and depend on the bytes alone, so they agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_RADIX = 0xD6E8FEB86659FD93
_K1, _K2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
STEP = _U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_HASH = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64 - 1, 256, np.uint64)
FOLDED_HASH = BYTE_HASH.copy()
FOLDED_HASH[65:91] = BYTE_HASH[97:123]
_powers = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse modulo 2**64."""
    have = _powers.get("n", 0)
    if have < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, radix in (("up", _RADIX), ("down", pow(_RADIX, -1, 2**64))):
            run = np.full(size, radix, np.uint64)
            run[0] = 1
            _powers[key] = np.multiply.accumulate(run)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (a bijection)."""
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last, bytes, offsets) of at most limit bytes, or of one longer row."""
    data, offs = column_bytes(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def prefix_hash(data: np.ndarray, table: np.ndarray = FOLDED_HASH) -> np.ndarray:
    """Running polynomial hash: see span_hash."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=run[1:])
    return run


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    body = (run[end] - run[start]) * powers(len(run))[1][start]
    return mix(body + (end - start).astype(np.uint64) * STEP)


def runs(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't breaks, never across rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    gap = breaks[data]
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    before[0] = after[-1] = True
    return np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1


class Words:
    """The words of a run of rows: start, end and hash of each, and first (n + 1 offsets into them by row)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = data
        self.start, self.end = runs(data, offs, SPACE)
        self.run = prefix_hash(data)
        self.hash = span_hash(self.run, self.start, self.end)
        self.first = np.searchsorted(self.start, offs)

    def stems(self, length: int) -> np.ndarray:
        """Hashes of the first bytes of each word."""
        return span_hash(self.run, self.start, np.minimum(self.end, self.start + length))


def join_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * STEP + hashes[k : n + k]
    return mix(out)


def shingles(words: Words, row: int, joined: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingles of a row; joined is join_hashes(words.hash, width).

    Fewer words than width count as one shingle, no words as none.
    """
    a, b = words.first[row], words.first[row + 1]
    if b - a >= width:
        return np.unique(joined[a : b - width + 1])
    if b > a:
        return mix(join_hashes(words.hash[a:b], int(b - a)) + _U(b - a))
    return np.zeros(0, np.uint64)


def set_hash(items: np.ndarray) -> int:
    """A hash of a set of 64-bit values, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(items).sum(dtype=np.uint64) + _U(len(items)) * STEP], np.uint64)).view(np.int64)[0])

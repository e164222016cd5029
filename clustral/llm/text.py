"""Texts as flat byte arrays: words, rolling hashes and shingle sets, by whole-array operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and the rows' offsets; null counts as empty."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = pc.fill_null(a.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (_BASE, inverse))
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash makes the hash of any span."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes, equal hash."""
    inverse = _powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased (A-Z) white-space separated words' hashes, and for each row the index of its first word."""
    low = _LOWER[data]
    ink = ~_SPACE[low]
    first, last = ink.copy(), ink.copy()
    if len(low):
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        full = off[1:] > off[:-1]
        first[off[:-1][full]] = ink[off[:-1][full]]
        last[off[1:][full] - 1] = ink[off[1:][full] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hash(prefix_hash(low), start, end), np.searchsorted(start, off)


def _joined(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    out = np.full(max(0, len(h) - n + 1), n, U)
    for k in range(n):
        out = mix(out * U(0xFF51AFD7ED558CCD) + h[k : k + len(out)])
    return out


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles' hashes in ascending order, and the rows' offsets.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    h, at = words(data, off)
    count = np.diff(at)
    whole = _joined(h, n)
    row = np.repeat(np.arange(len(count)), np.maximum(0, count - n + 1))
    first = np.repeat(at[:-1], np.maximum(0, count - n + 1))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(0, count - n + 1)) - np.maximum(0, count - n + 1), np.maximum(0, count - n + 1))
    values = whole[first + rank] if len(row) else np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        row = np.concatenate([row, short])
        values = np.concatenate([values, [_joined(h[at[i] : at[i + 1]], int(count[i]))[0] for i in short]]).astype(U)
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    return values, np.searchsorted(row, np.arange(len(count) + 1))


def sequence(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n words, in order, with repeats: hashes and the rows' offsets. Rows with fewer words have none."""
    h, at = words(data, off)
    whole = _joined(h, n)
    count = np.maximum(0, np.diff(at) - n + 1)
    out = np.concatenate([[0], np.cumsum(count)])
    take = np.repeat(at[:-1] - out[:-1], count) + np.arange(out[-1])
    return whole[take] if len(take) else np.zeros(0, U), out


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ U(0xA0761D6478BD642F)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U))

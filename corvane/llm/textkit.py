"""Vectorised text primitives over Arrow batches, shared by the text operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  They are found on the UTF-8 bytes of many
documents at once with numpy; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_IS_START = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64

#: Bytes that one vectorised step handles; temporaries take about ten times as much.
CHUNK = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE_VALUE[_LOWER]
_STEP = 0xD1342543DE82EF95


def _powers(n: int, step: int = _STEP) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(64)


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to
        at = to


def _cuts(buf: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Byte ranges that end behind a space, or within a word longer than `limit` only at the end of the text."""
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + limit)
        while to < n:
            near = np.flatnonzero(_IS_SPACE[buf[to : to + 4096]])
            if len(near):
                to += int(near[0]) + 1
                break
            to = min(n, to + 4096)
        yield at, to
        at = to


def words(buf: np.ndarray, offs: np.ndarray, *, hashes: bool = True, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Starts, ends, row numbers and 64-bit hashes of all words of the rows."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
    limits = np.unique(offs)
    for lo, hi in _cuts(buf, CHUNK):
        piece = buf[lo:hi]
        space = _IS_SPACE[piece]
        fresh = np.ones(hi - lo + 1, bool)
        fresh[1:-1] = space[:-1]
        inner = limits[np.searchsorted(limits, lo) : np.searchsorted(limits, hi)] - lo
        fresh[inner] = True
        ends_here = np.empty(hi - lo, bool)  # the next byte is a space or opens a row
        ends_here[:-1] = space[1:]
        ends_here[-1] = True
        ends_here[inner[inner > 0] - 1] = True
        starts = np.flatnonzero(fresh[:-1] & ~space)
        ends = np.flatnonzero(ends_here & ~space) + 1
        parts.append((starts + lo, ends + lo, _hash(piece, starts, ends, lower) if hashes else None))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64) if hashes else None
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    rows = np.searchsorted(offs[1:], starts, "right")
    return starts, ends, rows, np.concatenate([p[2] for p in parts]) if hashes else None


def _hash(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Polynomial hashes over random byte values, by position within the word, then mixed with the length."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    longest = int(length.max())
    if longest > len(_POWERS):
        _POWERS = _powers(longest + 64)
    # only words' bytes are looked at; byte k of a word has the power k
    value = (_BYTE_LOWER if lower else _BYTE_VALUE)[piece[~_IS_SPACE[piece]]]
    ends_at = np.cumsum(length)
    place = np.arange(len(value), dtype=np.int32)
    place -= np.repeat((ends_at - length).astype(np.int32), length)
    value *= _POWERS[place]
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix64((total[ends_at] - total[ends_at - length]) ^ (length.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word numbers and hashes of the windows of `size` words that lie within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return at, mix64(out[at])


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a byte-level array over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def code_points_in_words(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return per_row(_IS_START[buf] & ~_IS_SPACE[buf], offs)


def sorted_unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))

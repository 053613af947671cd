"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on flat byte buffers of many documents at once (the layout of an
Arrow string column), so that no Python code runs per word.  Words are maximal runs
of bytes outside 0x20 and 0x09-0x0D, which is what ``bytes.split()`` returns too.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators that leave letters only: all of ASCII but A-Z and a-z (bytes from 0x80 on are parts of letters).
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text hashed in one go; longer single documents are taken alone.
CHUNK = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, name: str) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=U64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
                done += take
        if size > 4 * CHUNK:
            return out[:n]
        _tables[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64); returns a new array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column = column.cast(pa.large_binary())
        width = np.int64
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) else b""
        column = column.fill_null(pa.scalar(empty, column.type))
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents that hold at most ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Words of a run of documents: byte bounds, a 64-bit hash of each, and word offsets by document."""

    __slots__ = ("buf", "start", "end", "hash", "first", "_total")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True, space: np.ndarray = _SPACE):
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        n = len(buf)
        text = ~space[buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        prev = np.empty(n, dtype=bool)
        if n:
            prev[0] = False
            prev[1:] = text[:-1]
        self.start = np.flatnonzero(text & (~prev | edge[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = text[1:]
        self.end = np.flatnonzero(text & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        n = len(self.buf)
        total = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((self.buf.astype(U64) + U64(1)) * _powers(_BASE, n, "pow"), out=total[1:])
        self._total = total
        return self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the given byte spans; equal bytes have equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            value = (self._total[end] - self._total[start]) * _powers(_BASE_INV, len(self.buf), "inv")[start]
            return mix(value + (end - start).astype(U64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, whatever document they are in (see ``gram_starts``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        acc = hashes[:n].copy()
        for j in range(1, k):
            acc *= U64(0xD6E8FEB86659FD93)
            acc += hashes[j : j + n]
    return mix(acc)


def gram_counts(first: np.ndarray, k: int) -> np.ndarray:
    return np.maximum(np.diff(first) - k + 1, 0)

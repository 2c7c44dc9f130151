"""Array kernels over the UTF-8 bytes of whole Arrow string columns.

Every kernel works on a block of consecutive documents: the bytes ``d`` and the
offsets ``o`` (one more than documents).  Blocks hold about BLOCK bytes, or one
document where that is longer, so memory follows the longest document and not
the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64

#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null has no bytes."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if off is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o.astype(np.int64)


def blocks(arr: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each block."""
    d, o = utf8(arr)
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield i, j, d[o[i] : o[j]], o[i : j + 1] - o[i]
        i = j


def per_doc(mask: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Sum of a mask (or numbers) over each document."""
    c = np.zeros(len(mask) + 1, np.float64 if mask.dtype.kind == "f" else np.int64)
    np.cumsum(mask, out=c[1:])
    return c[o[1:]] - c[o[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def runs(inside: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and after-last byte of each run of ``inside``, none across documents."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = o[:-1][o[:-1] < o[1:]]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = o[1:][o[:-1] < o[1:]] - 1
    end[tails] = inside[tails]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=U)


def run_hashes(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, the runs being apart."""
    n = e - s
    if not len(n):
        return np.zeros(0, U)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    k = np.arange(first[-1])
    within = k - np.repeat(first[:-1], n)
    vals = d[k + np.repeat(s - first[:-1], n)].astype(U)
    vals += U(1)
    vals *= powers(0x9E3779B97F4A7C15, int(n.max()))[within]
    return mix(np.add.reduceat(vals, first[:-1]) + n.astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of a block: starts, ends, hashes; ``of[i]:of[i+1]`` are document i's."""

    def __init__(self, d: np.ndarray, o: np.ndarray):
        self.start, self.end = runs(WORD[d], o)
        self.hash = run_hashes(d, self.start, self.end)
        self.of = np.searchsorted(self.start, o)
        self.count = np.diff(self.of)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on; whether all k are in its document."""
        h, n = self.hash, len(self.hash)
        stop = np.repeat(self.of[1:], self.count)
        g = np.zeros(n, U)
        at = np.arange(n)
        for j in range(k):
            g *= U(0xA0761D6478BD642F)
            part = np.zeros(n, U)
            part[: max(n - j, 0)] = h[j:]
            g += np.where(at + j < stop, part, U(0))
        return mix(g), at + k <= stop


def binary(rows: np.ndarray, null: np.ndarray) -> pa.Array:
    """An Arrow binary array of the rows of a uint8 matrix, null where ``null``."""
    n, w = rows.shape
    keep = ~null
    o = np.zeros(n + 1, np.int32)
    np.cumsum(keep * w, out=o[1:])
    valid = pa.py_buffer(np.packbits(keep, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(o.tobytes()), pa.py_buffer(np.ascontiguousarray(rows[keep]).tobytes())])

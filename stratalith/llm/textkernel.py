"""Vectorised word, shingle and window hashing over blocks of UTF-8 bytes.

Hashes are 64-bit and mixed non-linearly at each 8-byte block of a word, so structured texts
(runs, Thue-Morse words) don't collide more often than random ones.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # 64-bit hashes wrap
U = np.uint64
_C1, _C2, _C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_P = U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(step: Callable) -> Callable:
    """A step over batches that hands its memory back at its end: workers are reused, and allocators keep what they were given."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche."""
    x = x ^ (x >> U(30))
    x *= _C1
    x ^= x >> U(27)
    x *= _C2
    x ^= x >> U(31)
    return x


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``most`` bytes; null is empty."""
    n = len(column)
    if not n:
        return
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each document's words begin (one more than documents)."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(separator[data], out=inside[1:-1])
    cur = inside[1:-1]
    begin = cur & ~inside[:-2]
    stop = cur & ~inside[2:]
    edges = offs[:-1][np.diff(offs) > 0]
    begin[edges] = cur[edges]
    last = edges[1:] - 1
    stop[last] = cur[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    size = (ends - starts).astype(np.int64)
    h = size.astype(U) * _C3
    if not len(size):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.as_strided(padded[:8].view(U) if len(padded) >= 8 else padded, shape=(len(padded) - 7,), strides=(1,))
    at, left, idx = starts.astype(np.int64), size, np.arange(len(size))
    keep = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=U)
    step = U(1)
    while len(idx):
        block = view[at] & keep[np.minimum(left, 8)]
        h[idx] = mix((h[idx] ^ block) * _P + step * _C3)
        more = left > 8
        idx, at, left = idx[more], at[more] + 8, left[more] - 8
        step += U(1)
    return h


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive items (length len(h) - k + 1), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, have, power, width, at = np.zeros(n, U), h.copy(), _P, 1, 0
    rest = k
    while rest:
        if rest & 1:
            out = out * power + have[at : at + n]
            at += width
        rest >>= 1
        if rest:
            have = have[:-width] * power + have[width:]
            power = power * power
            width *= 2
    return mix(out ^ (U(k) * _C3))


def docs_of(bounds: np.ndarray) -> np.ndarray:
    """Document number of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def windows_ok(bounds: np.ndarray, k: int) -> np.ndarray:
    """Which word starts have k words in their document (length: words - k + 1)."""
    doc = docs_of(bounds)
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Boolean mask of the items within any of the runs [start, start + width)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0

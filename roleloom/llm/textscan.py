"""Vectorised scans of Arrow text columns: words, word hashes, shingles.

Words are maximal runs of bytes other than space and 0x09-0x0D.  A batch of
texts is scanned on its own UTF-8 buffer, no Python string is made.  Word
hashes are polynomial prefix sums modulo 2**64 over a random byte table, then
mixed; equal words have equal hashes, others differ but for chance (2**-64 a
pair).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
K1, K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text scanned at once.
CHUNK = 1 << 20

_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and extended by doubling."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(1, n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        _POW[base] = have = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= K1
    x ^= x >> np.uint64(27)
    x *= K2
    x ^= x >> np.uint64(31)
    return x


def text_views(column: pa.Array, limit: int = CHUNK):
    """Yield ``(first, count, bytes, offsets)`` for runs of rows of at most ``limit`` bytes (or one row).

    A null text counts as empty.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end - at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, outside: np.ndarray = SPACE):
    """Word starts, ends (bytes), hashes and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = ~outside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[(offs > 0) & (offs < n)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    value = (BYTE_LOWER if lower else BYTE)[data]
    value *= powers(BASE, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(BASE_INV, n)[starts])
    return starts, ends, hashes, np.searchsorted(starts, offs)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i; crosses texts, callers cut by text."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j, p in enumerate(powers(BASE, k)):
        out += h[j : len(h) - k + 1 + j] * p
    return mix(out)


def shingle_set(h: np.ndarray, sh: np.ndarray, a: int, b: int, k: int) -> np.ndarray:
    """Sorted distinct shingles of the words a..b-1; with fewer than k words the whole sequence is one."""
    n = b - a
    if n >= k:
        return np.unique(sh[a : b - k + 1])
    if not n:
        return np.empty(0, np.uint64)
    short = np.zeros(1, np.uint64)
    for j, p in enumerate(powers(BASE, n)):
        short += h[a + j : a + j + 1] * p
    return mix(short + np.uint64(0x5851F42D4C957F2D + n))


def long_lists(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    """A list column of the given arrays."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offs[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(kind) if flat.dtype != kind else flat))


def tidied(run):
    """A mapInArrow function that hands the worker's unused memory back at the end of a task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped

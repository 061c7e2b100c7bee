"""Words and shingles of whole batches of texts, as numpy arrays over their UTF-8 bytes.

A batch of an Arrow string column is cut into slices of whole texts of about half a megabyte, so memory
follows the slice and the longest text, never the partition. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None
_P = np.uint64(0x9E3779B97F4A7C15 | 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: everything but white space ...
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False
#: ... or, in lower-cased text, digits, letters and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(1 << bits, _P, np.uint64))


def powers(n: int) -> np.ndarray:
    return _powers(max(8, int(n).bit_length()))


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of each slice of a string column."""
    if len(col) == 0:
        return
    if pa.types.is_null(col.type):
        col = pa.array([""] * len(col))
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    trim()


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def words(low: np.ndarray, off: np.ndarray, kind: np.ndarray, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds) of the words; words of text i are bounds[i]:bounds[i + 1].

    With longest, words of more bytes are cut into pieces of that many.
    """
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    m = kind[low]
    heads = off[:-1][off[:-1] < n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = m[:-1]
    before[heads] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    if longest and len(starts) and (ends - starts).max() > longest:
        n = -(-(ends - starts) // longest)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        starts, stops = np.repeat(starts, n) + nth * longest, np.repeat(ends, n)
        ends = np.minimum(starts + longest, stops)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), bounds
    lens = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    vals = (low[m].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[at]
    return starts, ends, mix(np.add.reduceat(vals, first) + lens.astype(np.uint64)), bounds


def word_hash(word: str, lower: bool = True) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(LOWER[b] if lower else b, np.array([0, len(b)]), np.ones(256, bool))[2][0])


def shingle_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, regardless of text bounds."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i] + np.uint64(2 * i + 1))
    return h


def shingle_sets(low: np.ndarray, off: np.ndarray, k: int, kind: np.ndarray = NONSPACE) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; the whole sequence as one if it is shorter."""
    _, _, w, bounds = words(low, off, kind)
    h = shingle_hashes(w, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            yield shingle_hashes(w[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)

"""Vectorised text helpers shared by the operators: word spans and word hashes over whole batches.

A batch of texts is one byte buffer plus offsets, exactly as Arrow stores it, so that the work per
document is a handful of numpy calls over many documents at once. Words are runs of bytes other than
ASCII white space (0x20, 0x09-0x0D) after A-Z have been lowered.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, controls and ASCII punctuation: what lies between words that are compared without punctuation.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if offs is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_LIBC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: idle workers else hold what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _LIBC_TRIM is not None:
        _LIBC_TRIM(0)


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about `limit` bytes; a longer text is a run of its own."""
    data, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def word_spans(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, word starts, word ends, first word of each text: one more than there are texts)."""
    low = LOWER[data]
    word = np.zeros(len(low) + 2, dtype=bool)
    np.logical_not(blank[low], out=word[1:-1])
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offs] = True
    inner = word[1:-1]
    starts = np.flatnonzero(inner & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner & (~word[2:] | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial over random byte codes, mixed with the length."""
    power, inverse = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=U64)
    np.cumsum(BYTE_CODE[low] * power[: len(low)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Ordered hashes of `size` successive word hashes, for each start in the whole array (bounds are the caller's)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    h = words[:n].copy()
    for k in range(1, size):
        h = h * U64(0x9DDFEA08EB382D69) + words[k : k + n]
        h ^= h >> U64(32)
    return mix64(h)

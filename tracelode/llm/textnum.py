"""Vectorised work on whole texts as UTF-8 bytes: words, their 64-bit hashes and n-grams of them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []

#: Bytes of text that are worked on at once: the arrays made of them then stay in a worker's reach of 100 MB.
CHUNK = 1 << 19


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on batches; at its end the worker, which Spark keeps for other tasks, returns free memory to the system."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Returns the free memory of Arrow's pool and of the C library, and powers beyond a chunk's, to the system."""
    if _powers and len(_powers[0]) > CHUNK + 2:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's C library has it
    if trim is not None:
        trim(0)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (strings or binary), and where each begins (one more than there are); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.full(size, b))).cumprod(dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c such that (c[e] - c[s]) * inverse power of s depends on data[s:e] only."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=c[1:])
    return c


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and each document's first word (one more than there are)."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[:-1][offs[:-1] < len(data)]
    first[inner] = word[inner]
    inner = offs[1:][offs[1:] > 0] - 1
    last[inner] = word[inner]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and each document's first word."""
    s, e, bounds = spans(data, offs)
    c = prefix_hash(data)
    return mix((c[e] - c[s]) * powers(len(data) + 1)[1][s]), bounds


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words within documents, and each one's document.

    A document of fewer than n words, but one at least, has one shorter gram of all its words.
    """
    count = np.diff(bounds)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), k)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + bounds[doc]
    end = bounds[doc + 1]
    out = np.zeros(len(doc), np.uint64)
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    for j in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += np.where(at + j < end, padded[at + j], np.uint64(0)) if j else h[at]
    return mix(out), doc

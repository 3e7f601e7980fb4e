"""Words, word hashes and shingles of many texts at once, as numpy arrays.

Texts are handled as UTF-8 bytes. Words are maximal runs of bytes other than the six ASCII white-space
bytes 0x09-0x0D and 0x20. Every function here works on a bounded slice of whole texts; `slices` cuts a list
of texts so that a slice holds about `limit` bytes, or a single longer text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M = (1 << 64) - 1
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """The texts of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) that cover the texts in order."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=1)
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def released() -> None:
    """Gives memory that nothing uses any more back to the system: Spark keeps a Python worker for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(f: Callable) -> Callable:
    """A function of Arrow columns that leaves no unused memory with its worker."""

    @wraps(f)
    def run(*columns: pa.Array) -> pa.Array:
        try:
            return f(*columns)
        finally:
            released()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        out = []
        for step in (_BASE, _INVERSE):
            steps = np.full(size, step, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        if size > 4 * SLICE_BYTES:  # for one very long text only
            return out[0], out[1]
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of the bytes."""
    powers, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashed = (sums[end] - sums[start]) * inverse[np.minimum(start, len(inverse) - 1)]
    return mix64(hashed + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words(NamedTuple):
    """Words of a slice: bytes of all texts, where each word starts and ends in them, its text's number, its hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))[:-1]
    doc = np.searchsorted(begins, start, side="right") - 1
    return Words(data, start, end, doc, hashes(data, start, end))


def shingles(found: Words, n_docs: int, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of n words, in order of text; a text of 1 to n-1 words has one run of all."""
    count = np.bincount(found.doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    factors = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    total = len(found.hash)
    out_h, out_d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if total >= n:
        acc = np.zeros(total - n + 1, dtype=np.uint64)
        for j in range(n):
            acc += found.hash[j : total - n + 1 + j] * factors[j]
        whole = found.doc[: total - n + 1] == found.doc[n - 1 :]
        out_h, out_d = acc[whole], found.doc[: total - n + 1][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        acc = np.zeros(len(short), dtype=np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            acc[has] += found.hash[first[short[has]] + j] * factors[j]
        out_h, out_d = np.concatenate((out_h, acc + count[short].astype(np.uint64))), np.concatenate((out_d, short))
        order = np.argsort(out_d, kind="stable")
        out_h, out_d = out_h[order], out_d[order]
    return mix64(out_h), out_d

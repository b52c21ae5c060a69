"""Vectorised byte helpers shared by the operators that run numpy inside tasks.

All of them work on one flat ``uint8`` buffer that holds many texts back to
back plus their offsets, so that the cost per text is small.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that one vectorised step handles; longer texts form a step alone.
STEP_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ROOT = 0x9E3779B97F4A7C15  # odd base of the polynomial word hash
_ROOT_INV = pow(_ROOT, -1, 1 << 64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) and its n + 1 offsets."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(filled)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = filled.buffers()
    offsets = np.frombuffer(off, np.int64)[filled.offset: filled.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte kept."""
    return _LOWER[buf]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes together (a longer text is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (fixed public constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: What a Python worker keeps between tasks: one thing at a time, whichever operator asked for it last.
_SLOT: dict = {}


def kept(key, make: Callable):
    """``make()``, kept in this worker until another key is asked for. Workers are reused by later stages, so what
    one operator leaves behind must not add to the next one's memory."""
    if key not in _SLOT:
        _SLOT.clear()
        _POWERS.clear()
        _trim()
        _SLOT[key] = make()
    return _SLOT[key]


def forget() -> None:
    """Give up what earlier operators left in this worker; for operators that keep nothing themselves."""
    kept(None, lambda: None)


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc: the allocator gives back what it will
        pass


def frugal(run: Callable) -> Callable:
    """``run`` (a function for mapInArrow) whose worker gives freed memory back to the system when a task ends."""
    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root ** 0 .. n modulo 2^64; those of a usual step are kept."""
    size = max(n, STEP_BYTES + (STEP_BYTES >> 3))
    if size > n and root in _POWERS:
        return _POWERS[root][: n + 1]
    out = np.full(size + 1, root, dtype=U64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if size > n:
        _POWERS[root] = out
    return out[: n + 1]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` and how many each text has.

    A word's hash is a polynomial over its bytes, read off prefix sums, with
    its length mixed in; it depends on the word alone.
    """
    n_docs = len(offsets) - 1
    if len(buf) == 0:
        return np.zeros(0, U64), np.zeros(n_docs, np.int64)
    space = _SPACE[buf]
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = space[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = True
    after[full[1:] - 1] = True
    begin = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * powers(_ROOT, len(buf))[:-1], out=sums[1:])
    h = (sums[end] - sums[begin]) * powers(_ROOT_INV, len(buf))[begin]
    h = mix(h + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))
    per_doc = np.searchsorted(begin, offsets, side="left")
    return h, np.diff(per_doc)


def shingles(word_hash: np.ndarray, per_doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and how many each text has.

    A text with fewer words gives its whole sequence as one; one without words gives none.
    """
    first = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    made = np.where(per_doc >= size, per_doc - size + 1, (per_doc > 0).astype(np.int64))
    total = int(made.sum())
    doc = np.repeat(np.arange(len(per_doc)), made)
    rank = np.arange(total) - np.repeat(np.cumsum(made) - made, made)
    at = first[doc] + rank
    length = np.minimum(per_doc, size)[doc]
    h = length.astype(U64) * U64(0xA0761D6478BD642F)
    for k in range(size):
        inside = length > k
        w = word_hash[np.where(inside, at + k, 0)] if len(word_hash) else np.zeros(total, U64)
        h = np.where(inside, mix(h * U64(0xE7037ED1A0B428DB) + w), h)
    return h, made

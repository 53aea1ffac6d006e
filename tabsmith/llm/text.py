"""Vectorised words and shingles over Arrow string columns.

Words are runs of bytes other than space and 0x09-0x0D (other white space belongs to words), A-Z
lower-cased.  A word's hash is a polynomial of per-byte random values modulo 2^64, taken from
prefix sums over the raw bytes, so no Python string is made.  Texts are worked through in chunks
of about ``CHUNK`` bytes; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
WIDTH = 5
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def random64(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2 ** 64, n, dtype=U)


_BYTES = np.arange(256)
IS_WORD = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
#: Another alphabet: letters, digits, apostrophe and all bytes of longer UTF-8 sequences; the rest separates.
IS_LETTER = (_BYTES >= 0x80) | np.isin(_BYTES, [*range(48, 58), *range(65, 91), *range(97, 123), 39])
VALUE = random64(256, 1)[LOWER]
BASE = 0x9E3779B97F4A7C15  # odd
STEP = random64(WIDTH, 2) | U(1)
SHORT = random64(WIDTH, 3)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        inverse = pow(BASE, -1, 2 ** 64)
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b, U))]) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a run of texts: doc (index in the batch, ascending), hash, and byte places."""

    __slots__ = ("first", "last", "doc", "hash", "start", "end", "prefix", "counts")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column, prefix: int = 0, alphabet: np.ndarray = IS_WORD) -> Iterator[Words]:
    """The words of an Arrow string column, chunk by chunk; ``prefix``: also hash the first so many bytes."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        lo = int(offsets[i])
        raw, at = data[lo: int(offsets[j])], offsets[i: j + 1] - lo
        w = Words()
        w.first, w.last = i, j
        n = len(raw)
        inside = alphabet[raw]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        cuts = at[(at >= 0) & (at <= n)]
        starts = np.zeros(n + 1, bool)
        starts[cuts] = True
        s = np.flatnonzero(inside & (~before[:n] | starts[:n]))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
        e = np.flatnonzero(inside & (~after | starts[1:])) + 1
        p, q = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(VALUE[raw] * p[:n], out=total[1:])
        w.start, w.end = s, e
        w.doc = np.searchsorted(at, s, side="right") - 1 + i
        w.hash = mix64((total[e] - total[s]) * q[s] + (e - s).astype(U))
        w.prefix = mix64((total[np.minimum(e, s + prefix)] - total[s]) * q[s] + U(977)) if prefix else None
        w.counts = np.bincount(w.doc - i, minlength=j - i)
        yield w


def shingles(w: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every shingle; a text with fewer words has its whole sequence as one, one without words none."""
    n = len(w.hash)
    full = max(0, n - width + 1)
    h = np.zeros(full, U)
    for k in range(width):
        h += w.hash[k: full + k] * STEP[k]
    same = w.doc[:full] == w.doc[width - 1: width - 1 + full]
    h, d = h[same], w.doc[:full][same]
    few = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(few):
        first = np.concatenate([[0], np.cumsum(w.counts)])[few]
        x = SHORT[w.counts[few]].copy()
        for k in range(width - 1):
            has = w.counts[few] > k
            x[has] += w.hash[first[has] + k] * STEP[k]
        h, d = np.concatenate([h, x]), np.concatenate([d, few + w.first])
    return d, mix64(h)


def distinct(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) pairs sorted and without repeats."""
    order = np.argsort(h, kind="stable")
    low = d.min() if len(d) else 0
    narrow = (d - low).astype(np.uint16 if len(d) and d.max() - low < 65536 else np.int64)
    order = order[np.argsort(narrow[order], kind="stable")]
    d, h = d[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


def shingle_sets(column, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, offsets, hashes) per chunk: the sorted distinct shingles of texts first..last-1."""
    for w in words(column):
        d, h = distinct(*shingles(w, width))
        counts = np.bincount(d - w.first, minlength=w.last - w.first)
        yield w.first, w.last, np.concatenate([[0], np.cumsum(counts)]), h

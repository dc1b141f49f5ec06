"""Words, shingles and their 64-bit hashes, straight from Arrow text columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 equals the
pattern ``[^\\x20\\x09-\\x0D]+``.  Everything here runs inside Spark tasks on one
Arrow batch; texts are taken a few megabytes at a time, so neither a large batch
nor one very long text needs more memory than a small multiple of its own size.

Hashes are 64 bits wide: a word's hash is a polynomial in its bytes, finished by a
mixer; a window's hash is a mixed linear form of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the byte polynomial.
BASE = 0x9E3779B97F4A7C15 | 1
INV = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n at least."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        both = []
        for base in (BASE, INV):
            a = np.full(max(n, BLOCK + 1), base, U)
            a[0] = 1
            both.append(np.cumprod(a, dtype=U))
        if n > 4 * BLOCK:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def coefficients(n: int, salt: int = 0) -> np.ndarray:
    """n odd 64-bit constants for windows of n words."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x632BE59BD9B4E019) + U(977 * n + salt)) | U(1)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.ones(len(column), bool) if not column.null_count else np.asarray(column.is_valid())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), valid
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], valid


def groups(offsets: np.ndarray, size: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def find_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word i is buf[starts[i]:ends[i]]; those of document d are first[d] to first[d+1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    stops[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, block by block of the bytes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        top = int(ends[j - 1])
        up, down = powers(top - base + 1)
        sums = np.zeros(top - base + 1, U)
        np.cumsum((buf[base:top].astype(U) + U(1)) * up[: top - base], dtype=U, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[buf]


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of the windows of n consecutive words: entry i is of h[i:i+n]."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    c = coefficients(n, salt)
    out = h[:m] * c[0]
    for k in range(1, n):
        out += h[k : k + m] * c[k]
    return mix(out)


def window_sums(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of long windows by prefix sums of a polynomial: a few passes whatever n is."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.empty(m, U)
    step = max(BLOCK // 2, n)
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        part = h[lo : hi + n - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], dtype=U, out=sums[1:])
        at = np.arange(hi - lo)
        out[lo:hi] = mix((sums[at + n] - sums[at]) * down[at] + U(n))
    return out


def shingle_sets(h: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each document its distinct shingles of n words, sorted by hash; fewer words are one shingle, none are none."""
    w = windows(h, n)
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= n:
            s = np.sort(w[a : b - n + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            c = coefficients(b - a, 7919)
            yield mix((h[a:b] * c).sum(dtype=U, keepdims=True))
        else:
            yield h[:0]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)

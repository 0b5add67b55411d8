"""Vectorised work on UTF-8 bytes: words, lines, hashes of spans, sums by row.

Hashes are 64-bit: a sum of byte codes times powers of an odd constant, so that
the hash of any span comes from one running sum, then a finalising mix. Such sums
of certain spans of 512 bytes and more are equal whatever the constant; spans from
``LONG`` bytes on are therefore hashed by BLAKE2b, one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 256
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = _inv = np.ones(1, np.uint64)

#: Whitespace is bytes 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        seq = np.full(size, np.uint64(_ODD))
        seq[0] = 1
        _pow = np.cumprod(seq)
        seq[1:] = np.uint64(_INV)
        _inv = np.cumprod(seq)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit mix."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest runs of true bytes within a row: starts, ends, row of each."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[n] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    out = _sum_hash(raw, start, end)
    for k in np.flatnonzero(end - start >= LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _sum_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running-sum hashes of spans. A very long row is summed in pieces."""
    n, piece = len(raw), 1 << 20
    if n <= piece or not len(start):
        up, down = _powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[raw] * up[:n], out=run[1:])
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # spans in order that begin and end within a piece
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + piece, "right")))
        base = start[lo]
        up, down = _powers(int(end[hi - 1] - base) + 1)
        part = raw[base : end[hi - 1]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * up[: len(part)], out=run[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def row_sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum over the bytes of each row."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[at[1:]] - run[at[:-1]]


def windows(h: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of one row: first word, hash."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])
    code = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        code += h[k : len(h) - size + 1 + k] * np.uint64(_CODES[k])
    return first, mix(code[first])

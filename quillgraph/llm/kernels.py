"""Vectorised word kernels over UTF-8 bytes.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; multi-byte UTF-8 sequences hold no
such byte, so splitting bytes and splitting text agree. Hashes are 64 bits wide and the same on
every machine (no seeds, no floating point).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 17
_pow = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, _BLOCK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        p = np.full(size, _BASE, U)
        p[0] = 1
        q = np.full(size, inverse, U)
        q[0] = 1
        _pow.update(n=size, p=np.multiply.accumulate(p), q=np.multiply.accumulate(q))
    return _pow["p"], _pow["q"]


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with a line feed after each, and where each begins (one more at the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return buf, np.concatenate(([0], np.cumsum(lengths)))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every word."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~_SPACE[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z only. Worked off in blocks that fit the cache."""
    out = np.empty(len(starts), U)
    i, n = 0, len(starts)
    while i < n:
        a = starts[i]
        j = int(np.searchsorted(ends, a + _BLOCK, "right"))
        j = max(j, i + 1)
        b = ends[j - 1]
        part = buf[a:b]
        if lower:
            part = _LOWER[part]
        p, q = _powers(int(b - a) + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((part.astype(U) + U(1)) * p[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * q[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def doc_of(starts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which text each word belongs to."""
    return np.searchsorted(begins, starts, "right") - 1


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Order-sensitive hash of every n consecutive words of the buffer, across texts too."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, (salt * 2 + 1) & 0xFFFFFFFFFFFFFFFF, U)
    for k in range(n):
        out = out * U(0xC2B2AE3D27D4EB4F) + hashes[k : k + m]
        out ^= out >> U(29)
    return mix(out)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (one more entry at the end)."""
    return np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))

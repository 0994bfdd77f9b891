"""Vectorised hashing of bytes and words in numpy (unsigned 64-bit arithmetic wraps)."""

from __future__ import annotations

import numpy as np

M = 0x9E3779B97F4A7C15 | 1
M_INV = pow(M, -1, 1 << 64)
U = np.uint64

_powers = {M: np.ones(1, U), M_INV: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i < n."""
    p = _powers[base]
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
        _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """``c`` with ``c[j] - c[i]`` the polynomial of bytes i..j-1 times ``M ** i``."""
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    np.cumsum((data.astype(U) + U(1)) * powers(M, len(data)), out=c[1:])
    return c


def spans(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span from a :func:`prefix`; equal bytes give equal hashes anywhere."""
    return mix((c[end] - c[start]) * powers(M_INV, len(c))[start])


BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(text: str) -> np.ndarray:
    """Hash of every run of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    data = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, U)
    out, step = [], 1 << 20  # long texts piecewise: the powers table stays small
    if len(data) <= step:
        return spans(prefix(data), start, end)
    k = 0
    while k < len(start):
        j = max(k + 1, int(np.searchsorted(end, start[k] + step, "right")))
        part = data[start[k]:end[j - 1]]
        out.append(spans(prefix(part), start[k:j] - start[k], end[k:j] - start[k]))
        k = j
    return np.concatenate(out)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of ``k`` words, ascending; fewer words are one run."""
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    n = len(words) - k + 1
    h = np.full(n, k, U)
    for j in range(k):
        h = h * U(M) + words[j:j + n]
    return np.unique(mix(h))

"""Weighted five-word shingles of a text as 64-bit hashes, in NumPy."""

from __future__ import annotations

import re

import numpy as np

WORDS = 5
#: Words hashed at once, so that a very long text needs little memory beyond itself.
SEGMENT = 1 << 14

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_forward = _powers(_BASE, 1 << 12)
_backward = _powers(_INVERSE, 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment(words: list[str], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words: differences of a rolling polynomial, taken at word ends."""
    global _forward, _backward
    raw = " ".join(words).encode() + b" "
    flat = np.frombuffer(raw, np.uint8)
    if len(flat) > len(_forward):
        n = 1 << (len(flat) - 1).bit_length()
        _forward, _backward = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _forward[: len(flat)], out=sums[1:])
    ends = np.flatnonzero(flat == 0x20)
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(ends) - size + 1], ends[size - 1 :]
    return mix((sums[ends] - sums[starts]) * _backward[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and how often each occurs. A shorter text is one shingle; no word, none."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = min(size, len(words))
    last = len(words) - size + 1
    parts = [_segment(words[i : min(i + SEGMENT, last) + size - 1], size) for i in range(0, last, SEGMENT)]
    return np.unique(np.concatenate(parts), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Generalised Jaccard similarity of two weighted sets; two empty ones are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)

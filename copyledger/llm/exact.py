"""Integer inner products that are exact whatever the size of the components."""

from __future__ import annotations

import numpy as np

LARGEST = (1 << 63) - 1
PAIRS = 1 << 15


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in Python integers, held at the ends of a long."""
    return np.array([max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(p, q))))
                     for p, q in zip(a.tolist(), b.tolist())], np.int64)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``a`` with the rows ``j`` of ``b``, pair by pair.

    Where the lengths show that no sum reaches 2**62, longs are added; the
    others are added one by one without limit, and a product outside the range
    of a long is held at its end (``LARGEST``, negative or not)."""
    out = np.empty(len(i), np.int64)
    long_a, long_b = (np.linalg.norm(m.astype(float), axis=1) for m in (a, b))
    for lo in range(0, len(i), PAIRS):
        p, q = i[lo:lo + PAIRS], j[lo:lo + PAIRS]
        part = np.einsum("ij,ij->i", a[p], b[q])
        wide = long_a[p] * long_b[q] >= 2.0 ** 62
        if wide.any():
            part[wide] = _exact(a[p[wide]], b[q[wide]])
        out[lo:lo + PAIRS] = part
    return out


def best(key: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's ``k`` highest scores, ties by smaller id, sorted by key."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    begin = np.flatnonzero(np.diff(sorted_key, prepend=sorted_key[:1] - 1)) if len(order) else order
    place = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
    return order[place < k]

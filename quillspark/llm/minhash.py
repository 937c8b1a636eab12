"""MinHash of shingle hashes: multiplicative permutations of 64-bit hashes, minima cut to 32 bits."""

from __future__ import annotations

import numpy as np


def multipliers(n: int, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_minima(hashes: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """``out[k, i]``: the least ``hash * factor k`` of the i-th part; parts begin at ``starts`` and are not empty."""
    out = np.empty((len(factors), len(starts)), dtype=np.uint32)
    if len(starts):
        with np.errstate(over="ignore"):
            for k, a in enumerate(factors):
                out[k] = np.minimum.reduceat(hashes * a, starts) >> np.uint64(32)
    return out


def distinct_per_row(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every row, and their ``first``."""
    if len(first) == 2:
        h = np.unique(hashes)
        return h, np.array([0, len(h)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(len(first)))

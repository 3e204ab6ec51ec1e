"""Hilbert curve positions of points in a few dimensions, for arrays of points."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """uint64 position of each point (n, dimensions) of whole numbers below 2**bits; dimensions * bits <= 63.

    Skilling's transformation between axes and transposed index, on whole columns.
    """
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    n, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            up = (x[i] & np.uint64(q)) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(len(points), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) > 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << one) | ((v >> np.uint64(b)) & one)
    return key

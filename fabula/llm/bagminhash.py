"""BagMinHash signatures: unbiased sketches of weighted Jaccard similarity.

Every element of weight w holds a Poisson process on (0, w]; each of its points falls into one of m registers, which
keeps the earliest point it has seen. The weights are discretised to whole units and the process is split
hierarchically into the intervals (0, 1], (1, 2], (2, 4], (4, 8], ...: an interval produces its points at a rate
equal to its length, and a point counts only if its unit lies below the weight. Two multisets hold the same point in
a register with a probability equal to their weighted Jaccard similarity. A document's elements stop producing
points once these come later than every register's, which makes the cost nearly independent of the number of
elements. The first interval alone gives the signature of the set; the others are added to it. All documents of a
batch run together in NumPy.
"""

from __future__ import annotations

import numpy as np

from fabula.functions.words import mix

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_GOLDEN = _U(_STEP)


def _multiple(n: int) -> np.uint64:
    return _U(n * _STEP & 0xFFFFFFFFFFFFFFFF)


def _fill(signature: np.ndarray, doc: np.ndarray, state: np.ndarray, start: np.ndarray, width: np.ndarray, limit: np.ndarray) -> None:
    """The points of one interval of each element (start, start + width], put into the registers of its document."""
    n_docs, registers = signature.shape
    flat = signature.reshape(-1)
    own, x = doc, np.zeros(len(doc))
    single = bool((width == 1).all())  # every point of such an interval counts
    latest = signature.max(1) if n_docs else np.empty(0)
    turn = 0
    while len(own):
        turn += 1
        u = mix(state + _multiple(turn))
        gap = -np.log(((u >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53)
        x += gap if single else gap / width
        keep = x < latest[own]
        if not keep.all():
            own, x, state, u = own[keep], x[keep], state[keep], u[keep]
            if not single:
                limit, start, width = limit[keep], start[keep], width[keep]
        v = mix(u ^ _U(0xD6E8FEB86659FD93))
        cell = own * registers + (((v >> _U(32)) * _U(registers)) >> _U(32)).astype(np.int64)
        if single:
            np.minimum.at(flat, cell, x)
        else:
            seen = start + (((v & _U(0xFFFFFFFF)) * width.astype(_U)) >> _U(32)).astype(np.int64) < limit
            np.minimum.at(flat, cell[seen], x[seen])
        if turn >= 3:
            latest = signature.max(1)


def set_signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, registers: int, seed: int = 1) -> np.ndarray:
    """float64 array (n_docs, registers): the earliest points of the first interval, which every element has; those of
    the documents' sets. A document without elements has inf everywhere."""
    signature = np.full((n_docs, registers), np.inf)
    one = np.ones(len(doc), np.int64)
    _fill(signature, doc, mix(element + mix(np.zeros(1, _U) + _multiple(seed))), one * 0, one, one)
    return signature


def bag_signatures(sets: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, seed: int = 1) -> np.ndarray:
    """The signatures of multisets from those of their sets: the points of the higher intervals are added. Only
    elements of a weight above 1 have any; of these only the ones earlier than a register are made."""
    signature = sets.copy()
    level = 1
    while len(more := np.nonzero(weight > 1 << (level - 1))[0]):
        start = np.full(len(more), 1 << (level - 1), np.int64)
        _fill(signature, doc[more], mix(element[more] + mix(np.full(1, level, _U) + _multiple(seed))), start, start, weight[more].astype(np.int64))
        level += 1
    return signature


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int, seed: int = 1) -> np.ndarray:
    """float64 array (n_docs, registers) of the earliest points of multisets.

    doc: document number of every element; element: its uint64 hash; weight: its whole-number weight, 1 at least.
    """
    return bag_signatures(set_signatures(doc, element, n_docs, registers, seed), doc, element, weight, seed)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The estimate of two signatures: the share of registers with the same point."""
    return float(((a == b) & np.isfinite(a)).mean())


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """uint64 array (n_docs, bands): one key for each band of `rows` registers."""
    points = mix(np.ascontiguousarray(signature).view(_U)).reshape(len(signature), -1, rows)
    key = np.arange(1, points.shape[1] + 1, dtype=_U)[None, :] * _GOLDEN
    for i in range(rows):
        key = mix(key + points[:, :, i])
    return key


def bit_sketch(signature: np.ndarray, bits: int = 128) -> np.ndarray:
    """uint64 array (n_docs, bits // 64): one hashed bit of each of the first `bits` registers."""
    one = (mix(np.ascontiguousarray(signature[:, :bits]).view(_U) ^ _GOLDEN) >> _U(17)).astype(np.uint8) & 1
    return np.packbits(one, axis=1).view(_U)

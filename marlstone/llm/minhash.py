"""SuperMinHash signatures in numpy, many documents at a time.

Element x of a set draws, for j = 0, 1, ..., a number r_j in [0, 1) and one step of
a Fisher-Yates shuffle of the slots; the slot drawn at step j gets min(j + r_j).
Ranks of one element are thus correlated: all different. A document stops at the
first j that exceeds all its slots, for no later step can lower any.
"""

from __future__ import annotations

import numpy as np

from .common import GOLDEN, mix

U32 = np.uint64(32)


def signatures(elements: np.ndarray, owner: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """(n_docs, slots) of float64; elements are 64-bit hashes, distinct within their owner. Rows without elements stay at inf."""
    sig = np.full(n_docs * slots, np.inf)
    x, own = elements, owner
    shuffled = None
    for j in range(slots):
        with np.errstate(over="ignore"):
            h = mix(x + GOLDEN * np.uint64(j + 1))
        k = j + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> U32).astype(np.int64)
        value = j + (h >> U32).astype(np.float64) / 2**32
        if j == 0:
            slot = k
        else:
            if shuffled is None:
                shuffled = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(x), 1))
                first = k_before
                rows = np.arange(len(x))
                shuffled[rows, first], shuffled[rows, 0] = 0, first
            rows = np.arange(len(x))
            slot = shuffled[rows, k].astype(np.int64)
            shuffled[rows, k], shuffled[rows, j] = shuffled[rows, j].copy(), slot
        np.minimum.at(sig, own * slots + slot, value)
        open_ = sig.reshape(n_docs, slots).max(1) > j + 1
        stay = open_[own]
        if not stay.any():
            break
        x, own, k_before = x[stay], own[stay], k[stay]
        if shuffled is not None:
            shuffled = shuffled[stay]
    return sig.reshape(n_docs, slots)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n_docs, bands) of int64: a hash of each run of slots / bands values."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    with np.errstate(over="ignore"):
        h = np.full(bits.shape[:2], np.uint64(bands), np.uint64)
        for i in range(bits.shape[2]):
            h = mix((h + GOLDEN) ^ bits[:, :, i])
    return h.view(np.int64)

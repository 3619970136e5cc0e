"""Hilbert keys of quantised points, for all rows of an array at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """rows x bytes: the place of each row's cell on the Hilbert curve, most significant byte first.

    cells: rows x dimensions, integers below 2**bits. The curve's frame (which axis comes first, which are mirrored) is carried
    from the coarsest bit to the finest by the usual exchange and inversion rules; then the bits are Gray-decoded and interleaved.
    """
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = q - np.uint32(1)
        for i in range(d):
            set_ = (x[i] & q) != 0
            t = np.where(set_, np.uint32(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, t)
            if i:
                x[i] ^= t
        q >>= np.uint32(1)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - np.uint32(1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= t
    planes = np.stack([(x[i] >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1) for i in range(d)], 1)
    return np.packbits(planes.astype(np.uint8), axis=1)

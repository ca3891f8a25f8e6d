"""SuperMinHash signatures, many sets at a time.

For an element, step j draws a number in [j, j + 1) and a slot from a random permutation of
the slots, the next one at every step; a slot keeps the least number.  All elements of a
block of sets take a step together.  A set is done when every slot holds a number below the
next step, so large sets end after a few steps.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_STEP = 0x9E3779B97F4A7C15


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` 64-bit values per set; sets without elements have the largest
    value everywhere.  elements: distinct 64-bit hashes of all sets, cut at offsets."""
    n_sets = len(offsets) - 1
    out = np.full((n_sets, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n_sets), np.diff(offsets))
    seeds = elements.copy()
    perm: np.ndarray | None = None
    for j in range(slots):
        if not len(seeds):
            break
        draw = mix(seeds + np.uint64(_STEP * (j + 1) % 2**64))
        other = (j + ((draw >> np.uint64(40)) * np.uint64(slots - j) >> np.uint64(24))).astype(np.int64)
        if j == 0:
            slot = other
        else:
            at = np.arange(len(seeds))
            slot = perm[at, other].astype(np.int64)
            perm[at, other] = perm[:, j]
        number = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner * slots + slot, number)
        busy = out.max(axis=1) >= np.uint64((j + 1) << 32)
        stay = busy[owner]
        if j == 0:
            if not stay.any():
                break
            first = other[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(first), 1))
            perm[np.arange(len(first)), first] = 0
        elif not stay.all():
            perm = perm[stay]
        seeds, owner = seeds[stay], owner[stay]
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band; equal only for equal rows of the same band."""
    n, slots = signature.shape
    rows = slots // bands
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        h = np.full(n, b + 1, np.uint64)
        for k in range(rows):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + signature[:, b * rows + k])
        out[:, b] = h
    return out

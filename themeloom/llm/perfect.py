"""Minimal perfect hash over distinct digests, built level by level in numpy.

Each level hashes the keys that are left into a bit field of about twice their
number. Keys that are alone on their bit settle there; the others go on to the
next level. The slot of a key is the number of set bits before its own, so n keys
fill the slots 0 .. n-1 with no gap and about three bits a key.
"""

from __future__ import annotations

import numpy as np

from themeloom.llm.words import mix

WIDTH = 32
SPREAD = 2.0


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    halves = np.ascontiguousarray(digests[:, 8:24]).view(np.uint64)
    return halves[:, 0], halves[:, 1]


def _places(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(2 * level + 1)
    return (mix(low * step + high) % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Bit fields of the levels, and the slot of each of the distinct digests."""
    low, high = _keys(digests)
    left = np.arange(len(digests))
    fields: list[bytes] = []
    slots = np.empty(len(digests), np.int64)
    base, level = 0, 0
    while len(left):
        size = max(64, int(SPREAD * len(left)) + 63 & ~63)
        place = _places(low[left], high[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        bits = np.zeros(size, bool)
        bits[place[settled]] = True
        order = np.cumsum(bits) - 1
        slots[left[settled]] = base + order[place[settled]]
        base += int(bits.sum())
        fields.append(np.packbits(bits, bitorder="little").tobytes())
        left = left[~settled]
        level += 1
    return fields, slots


def find(fields: list[bytes], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest. A digest outside the set gets -1 or the slot of another
    one, so the full digest in the slot has to be compared."""
    low, high = _keys(digests)
    slots = np.full(len(digests), -1, np.int64)
    open_, base = np.arange(len(digests)), 0
    for level, field in enumerate(fields):
        bits = np.unpackbits(np.frombuffer(field, np.uint8), bitorder="little")
        before = np.cumsum(bits, dtype=np.int64) - 1
        place = _places(low[open_], high[open_], level, len(bits))
        hit = bits[place] == 1
        slots[open_[hit]] = base + before[place[hit]]
        open_ = open_[~hit]
        base += int(before[-1]) + 1
    return slots

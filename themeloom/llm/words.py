"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than space and U+0009 to U+000D in the UTF-8 text,
which is the pattern ``[^\\x20\\x09-\\x0D]+``. Words are never copied out: they
are described by byte positions and a 64-bit fingerprint. Batches are handled in
pieces of a few MB, so memory follows the piece and the longest single document,
not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer document is a piece of its own).
PIECE = 4 << 20
#: Bytes fingerprinted at once; a longer word is digested on its own.
SPAN = 1 << 18
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STORE: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Byte classes, random byte values, powers of an odd base and their inverses."""
    if not _STORE:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        random = np.random.default_rng(20240101)
        for name, factor in (("powers", base), ("inverses", inverse)):
            steps = np.full(SPAN + 1, factor, np.uint64)
            steps[0] = 1
            _STORE[name] = np.multiply.accumulate(steps)
        _STORE["value"] = random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        _STORE["white"] = white
    return _STORE


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


@dataclass
class Piece:
    """Documents ``first`` .. ``first + len(self) - 1`` of a batch.

    ``bounds[i] : bounds[i + 1]`` are the bytes of document i in ``data``;
    ``begins[i] : begins[i + 1]`` are its words in ``starts``, ``ends``, ``marks``.
    """

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    marks: np.ndarray
    begins: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.begins)

    def owner(self) -> np.ndarray:
        """Document of each word, counted from the start of the piece."""
        return np.repeat(np.arange(len(self)), self.counts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    texts = texts.fill_null("")
    _, places, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit values that depend on the bytes of each [start, end) alone."""
    t = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(ends, low + SPAN, "right"))
        if to <= at:  # longer than a span
            digest = hashlib.blake2b(data[low : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        high = ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(t["value"][data[low:high]] * t["powers"][: high - low], out=sums[1:])
        from_ = starts[at:to] - low
        out[at:to] = mix((sums[ends[at:to] - low] - sums[from_]) * t["inverses"][from_])
        at = to
    return out


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word crosses a bound."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _tables()["white"][data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = white[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = white[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    inside = ~white
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def pieces(texts: pa.Array, limit: int = PIECE, lower: bool = False) -> Iterator[Piece]:
    """The documents of a column in pieces of about ``limit`` bytes, in order;
    ``lower`` turns A to Z into a to z first."""
    data, offsets = buffers(texts)
    small = np.arange(256, dtype=np.uint8)
    small[65:91] += 32
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if lower:
            part = small[part]
        bounds = offsets[at : to + 1] - offsets[at]
        starts, ends = words_of(part, bounds)
        yield Piece(
            at, part, bounds, starts, ends, fingerprints(part, starts, ends), np.searchsorted(starts, bounds)
        )
        at = to


def grams(marks: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n words that start at each position (fewer positions than words)."""
    if len(marks) < n:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    out = marks[: len(marks) - n + 1].copy()
    for k in range(1, n):
        out = out * factor + marks[k : len(marks) - n + 1 + k]
    return mix(out)


def grams_inside(piece: Piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``grams`` of a piece and which of them stay inside one document."""
    values = grams(piece.marks, n)
    owner = piece.owner()
    return values, owner[: len(values)] == owner[n - 1 :] if len(values) else np.zeros(0, bool)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def chunk(batch: pa.RecordBatch, name: str, piece: Piece) -> pa.Array:
    """The rows of a column that belong to a piece."""
    return column(batch, name).slice(piece.first, len(piece))

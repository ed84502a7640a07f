"""Secrets in texts: fixed patterns, and values in credential places that are hard to guess.

Three patterns find assignments, access keys and hexadecimal strings. Besides, every
value in a credential place (after a credential word with ``:`` or ``=``, or between
user and host of an address) that no pattern took is split at least cost into words,
dates, repeats, walks and forced characters; a value that takes at least
``10 ** threshold`` guesses is a span of kind ``guess``.

One pass over the texts, no shuffle. Results for odd rows: null and empty texts have
no spans; repeated rows get equal results; a null id is kept; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.guesses import cost
from themeloom.llm.words import buffers, column

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # a run is taken from its first character, so short runs drop here
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
PLACES = re.compile(
    rb"""(?:password|passwd|passphrase|pass|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)"""
    rb"""["']?[\x20\t]*[:=][\x20\t]*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"'<>]{6,}))""",
    re.IGNORECASE,
)
PLACE_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential")
ADDRESS = re.compile(rb"://[^\s:/@]+:([^\s@/]{6,})@")
SPANS = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_guess long, max_log10_guesses double"
)
THRESHOLD = 8.0


def _base(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int, int]] = []
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def _guessed(text: bytes, low: bytes, taken: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int, float]]:
    """Values in credential places outside ``taken`` that reach the threshold."""
    values: set[tuple[int, int]] = set()
    if any(word in low for word in PLACE_WORDS):
        values |= {m.span(m.lastindex) for m in PLACES.finditer(text)}
    if b"://" in low:
        values |= {m.span(1) for m in ADDRESS.finditer(text)}
    out = []
    for a, b in sorted(values):
        while b > a and text[b - 1 : b] in (b".", b",", b";", b")", b"!", b"?"):
            b -= 1
        if b - a < 6 or any(a < end and start < b for start, end, _ in taken):
            continue
        price = cost(text[a:b].decode("utf-8", "replace"))
        if price >= threshold and not any(a < end and start < b for start, end, _, _ in out):
            out.append((a, b, 3, price))
    return out


def _positions(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte positions as code points, ordered by start and kind."""
    if text.isascii():
        points = [(a, b, k) for a, b, k in spans]
    else:
        lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        before = lambda at: int(lead[at - 1]) if at else 0
        points = [(before(a), before(b), k) for a, b, k in spans]
    return sorted(points, key=lambda s: (s[0], s[2]))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and spans for each row of ``docs``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(column(batch, "text"))
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                text = data[a:b].tobytes()
                low = text.lower()
                base = _base(text, low)
                more = _guessed(text, low, base, threshold)
                fixed = _positions(text, base)
                every = _positions(text, base + [(a, b, k) for a, b, k, _ in more])
                digest = hashlib.sha256(_written(fixed).encode()).hexdigest()
                counts = [sum(k == kind for _, _, k in base) for kind in range(3)]
                rows.append((*counts, digest, _written(every), len(more), max((p for *_, p in more), default=0.0)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]
            cells = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SPANS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SPANS)

"""How many guesses a value takes: the cheapest way to split it into known parts.

Parts are words of a list, dates, repeated characters, keyboard and alphabet walks,
word-like letters, and single characters tried by force. Dynamic programming over the
positions of the value finds the split with the least product of part costs; costs
are kept as decimal logarithms. Each position looks at parts of bounded length and at
runs that are measured once, so the time is linear in the value.
"""

from __future__ import annotations

import math
import re

# Words that guessers try first, most usual first.
COMMON_WORDS = (
    "password admin welcome letmein qwerty login secret dragon monkey master hello "
    "sunshine princess football baseball iloveyou shadow superman michael summer winter "
    "spring autumn monday friday january october december changeme default test user "
    "guest root server system access token example sample demo love flower freedom "
    "computer internet service private public company office mustang hunter killer "
    "pepper ginger cheese cookie banana orange purple silver golden yellow london paris"
).split()
#: Rows of a keyboard and orders that people follow.
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"
)
#: An unknown pronounceable word is one of so many.
UNKNOWN_WORDS = 6.0
#: Price of starting another part.
JOINT = math.log10(2)
LETTERS = re.compile(r"[a-z]{3,}")
HARD_LETTERS = re.compile(r"[^aeiouy]{5,}")

_RANKS = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
_LONGEST = max(map(len, COMMON_WORDS))
_NEXT: dict[str, set[str]] = {}
for _row in WALKS:
    for _a, _b in zip(_row, _row[1:]):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)


def _force(char: str) -> float:
    """One character by force: digits, letters of one case, or anything else."""
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isascii() and char.isalpha() else math.log10(33)


def _run_ends(low: str, follows) -> list[int]:
    """For each position the end of the longest run from it in which each character
    follows the one before."""
    ends = list(range(1, len(low) + 1))
    for i in range(len(low) - 2, -1, -1):
        if follows(low[i], low[i + 1]):
            ends[i] = ends[i + 1]
    return ends


def cost(value: str) -> float:
    """Decimal logarithm of the guesses for ``value``; 0 for an empty one."""
    low = value.lower()
    n = len(low)
    best = [math.inf] * (n + 1)
    best[0] = -JOINT
    walks = _run_ends(low, lambda a, b: b in _NEXT.get(a, ()))
    repeats = _run_ends(low, lambda a, b: a == b)
    dates = {i: m.end() for i in range(n) if low[i].isdigit() and (m := DATE.match(low, i))}
    words = {m.start(): m.end() for m in LETTERS.finditer(low) if not HARD_LETTERS.search(m.group())}
    upper = [0]
    for char in value:
        upper.append(upper[-1] + char.isupper())

    def case(i: int, j: int) -> float:
        """Other capitals than none, first or all double the guesses for each letter."""
        capitals = upper[j] - upper[i]
        if not capitals:
            return 0.0
        return JOINT if capitals == j - i or (capitals == 1 and value[i].isupper()) else JOINT * (j - i)

    forced = [False] * (n + 1)
    for i in range(n):
        start = best[i] + JOINT

        def offer(j: int, price: float) -> None:
            if start + price < best[j]:
                best[j] = start + price
                forced[j] = False

        single = best[i] + (0 if forced[i] else JOINT) + _force(low[i]) + (JOINT if value[i].isupper() else 0)
        if single < best[i + 1]:
            best[i + 1] = single
            forced[i + 1] = True
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            if rank := _RANKS.get(low[i:j]):
                offer(j, math.log10(rank + 1) + case(i, j))
        if i in words:
            offer(words[i], min(UNKNOWN_WORDS, (words[i] - i) * math.log10(26)) + case(i, words[i]))
        if i in dates:
            offer(dates[i], 2.0 if dates[i] - i <= 4 else 4.6)
        for ends, price in ((walks, 2.0), (repeats, 1.5)):
            if ends[i] - i >= 3:
                offer(ends[i], price + math.log10(ends[i] - i))
    return max(0.0, best[n])

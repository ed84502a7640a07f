"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rank(doc_id):
    """A null id is larger than any other."""
    return (doc_id is None, doc_id)


def stripped(docs, window=50):
    """One result for each row, in order: n_words, n_removed, kept_sha256."""
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key not in first or rank(doc_id) < rank(first[key]):
                first[key] = doc_id
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for s in range(len(w) - window + 1):
            if rank(first[tuple(w[s : s + window])]) < rank(doc_id):
                gone |= set(range(s, s + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def copies(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for doc_id, text in docs:
        low = (text or "").translate(LOWER)
        ids = groups[low]
        known = [i for i in ids if i is not None]
        out.append((doc_id, max(known) if known else None, len(ids), sha(low)))
    return out


def rules(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, copied = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            copied += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), copied, len(again), failed)


def similar(docs, n=4, percent=85):
    """(doc_id, set size, component) of each row; ids are distinct or null."""
    sets = []
    for _, text in docs:
        w = words((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(docs)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [(d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(docs)]


def base_spans(text):
    """(start, kind order, end) of the fixed patterns, in code points."""
    text = text or ""
    out = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, (pattern, least, group) in enumerate(((assign, 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0))):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def least_padding(histogram, buckets):
    """Least total padding by trying every set of bounds."""
    from itertools import combinations

    lengths = sorted(histogram)
    best = None
    for k in range(min(buckets, len(lengths))):
        for chosen in combinations(lengths[:-1], k):
            bounds = [*chosen, lengths[-1]]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram.items())
            best = cost if best is None else min(best, cost)
    return best

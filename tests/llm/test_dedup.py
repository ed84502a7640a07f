"""Substring dedup, exact dedup and the n-gram join against plain versions."""

import random

import numpy as np
import pytest

from tests.llm import brute
from themeloom.llm import components, exact, jaccard, lookups, perfect, substrings
from themeloom.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, source string, sid string, token string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    letters = "abcdefghij"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["É", "ü"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = text(70), text(30)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, "one two"), (None, "one two"), (None, text(80))]
    rows += [(10 + i, f"{text(rng.randint(0, 40))} {passage}\n{text(rng.randint(0, 40))}") for i in range(12)]
    rows += [(30 + i, f"{text(rng.randint(0, 40))} {line} {text(rng.randint(30, 60))}") for i in range(12)]
    base = text(300).split()
    for i in range(12):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((50 + i, " ".join(copy)))
    rows += [(70, text(20_000)), (71, rows[8][1]), (72, rows[8][1].upper()), (73, ("la " * 200).strip())]
    rng.shuffle(rows)
    return rows


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("settings", [substrings.SubstringSettings(), substrings.SubstringSettings(hot_segments=1, shard_words=500)])
def test_passages(spark, corpus, settings):
    got = substrings.strip_passages(frame(spark, corpus), settings).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute.stripped(corpus), key=key)
    assert any(r.n_removed for r in got)


def test_passages_of_repeated_ids(spark, corpus):
    text = next(t for i, t in corpus if i == 50)
    rows = [(7, text), (7, text), (7, "x " + text), (8, text), (9, "no copy")]
    got = substrings.strip_passages(frame(spark, rows)).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(brute.stripped(rows))


def test_matching_statistics():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 60)
    bounds = np.append(0, np.cumsum(sizes))
    symbols = rng.integers(1, 4, bounds[-1])
    labels = rng.integers(0, 9, 60)
    index = FMIndex(symbols, bounds, 4, labels)
    whose = np.repeat(np.arange(60), sizes)
    ends = np.flatnonzero(np.arange(len(symbols)) - bounds[whose] >= 4) + 1
    matched, smaller = index.suffix_matches(symbols, ends, labels[whose[ends - 1]], 5)
    texts = ["".join(map(str, symbols[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    flat = "".join(map(str, symbols))
    for e, m, s in zip(ends, matched, smaller, strict=True):
        count = lambda n: sum(t.startswith(flat[e - n : e], i) for t in texts for i in range(len(t)))
        assert m == max(n for n in range(6) if n == 0 or count(n) > 1)
        pattern = flat[e - 5 : e]
        assert s == any(pattern in t and labels[j] < labels[whose[e - 1]] for j, t in enumerate(texts))


def test_perfect_hash_has_no_gap():
    keys = np.random.default_rng(2).integers(0, 256, (3000, 32), dtype=np.uint8)
    fields, slots = perfect.build(keys)
    assert sorted(slots) == list(range(3000))
    assert (perfect.find(fields, keys) == slots).all()
    assert perfect.build(keys[:0])[0] == [] and (perfect.find([], keys[:5]) == -1).all()


def test_exact_copies(spark, corpus):
    got = exact.copies(frame(spark, corpus)).collect()
    want = brute.copies(corpus)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len({w[3] for w in want})
    assert {r.in_history for r in got} == {True, False}
    kept = exact.drop_copies(frame(spark, corpus))
    assert kept.columns == ["doc_id", "text", "source", "sid", "token"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_exact_copies_of_repeated_ids(spark):
    rows = [(5, "A b"), (5, "a B"), (5, "other"), (9, "OTHER"), (5, "third"), (5, "third")]
    got = exact.copies(frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 3 and {r.group_size for r in got} == {2}
    kept = {(r.doc_id, r.text.lower()) for r in exact.drop_copies(frame(spark, rows)).collect()}
    assert kept == {(5, "a b"), (9, "other"), (5, "third")}
    assert exact.drop_copies(frame(spark, rows)).count() == 3


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_similar_sets(spark, corpus, n, percent):
    settings = jaccard.JaccardSettings(words=n, percent=percent)
    got = jaccard.similar(frame(spark, corpus), settings).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute.similar(corpus, n, percent), key=key)
    kept = jaccard.keep_one(frame(spark, corpus), settings)
    assert kept.columns == ["doc_id", "text", "source", "sid", "token"]


def test_similar_with_narrow_frequencies(spark, corpus):
    """Any order of tokens gives the same links."""
    settings = jaccard.JaccardSettings(width=8)
    got = jaccard.similar(frame(spark, corpus), settings).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute.similar(corpus), key=key)


@pytest.mark.parametrize("percent,block", [(85, 256), (85, 8)])
def test_links_inside_components_are_counted(spark, corpus, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    base = [f"word{i}" for i in range(120)]
    texts = [" ".join(base)] * 3
    for i in range(40):  # distinct near copies, some of them not similar to each other
        own = list(base)
        for k in rng.sample(range(120), rng.randint(1, 3)):
            own[k] = f"new{i}_{k}"
        texts.append(" ".join(own))
    rows = corpus + [(10_000 + i, t) for i, t in enumerate(texts)]
    settings = jaccard.JaccardSettings(percent=percent)
    got = jaccard.counted(frame(spark, rows), settings).collect()
    words = [brute.words((t or "").translate(brute.LOWER)) for _, t in rows]
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in words]
    want = []
    for i, (doc, _) in enumerate(rows):
        near = [k for k, s in enumerate(sets) if k != i and s and sets[i] and 100 * len(s & sets[i]) >= percent * len(s | sets[i])]
        want.append((doc, len(sets[i]), len(near)))
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=key) == sorted(want, key=key)
    assert max(w[2] for w in want) > 3
    plain = jaccard.similar(frame(spark, rows), settings).collect()
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted((tuple(r) for r in plain), key=key)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}


def test_likely_rows(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(200)] + [(None, "t")], "doc_id long, text string")
    ids = spark.createDataFrame([(3,), (150,), (None,)], "doc_id long")
    got = {r.doc_id for r in lookups.likely(docs, ids).collect()}
    assert {3, 150, None} <= got and len(got) < 20
    assert lookups.likely(docs, ids, 1).count() == 201  # a full map passes all rows
    assert lookups.likely(docs, ids.limit(0)).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.strip_passages(none).count() == 0
    assert exact.copies(none).count() == 0 and exact.drop_copies(none).count() == 0
    assert jaccard.similar(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_links_of_a_cluster_are_counted_without_its_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base, other = ([rng.choice(words) for _ in range(300)] for _ in range(2))
    far = list(base)
    for i in range(0, 40, 4):
        far[i] = "far"
    rows = [(i, " ".join([*base[: 5 * i], f"new{i}", *base[5 * i + 1 :]])) for i in range(1, 50)]
    rows += [(i + 100, t) for i, t in rows[:9]] + [(201, " ".join(far)), (202, " ".join(other)), (203, " ".join(base))]
    made = []
    every_pair = jaccard.every_pair
    monkeypatch.setattr(jaccard, "every_pair", lambda *a: made.append(every_pair(*a)) or made[-1])
    got = jaccard.counted(frame(spark, rows)).collect()
    words_of = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in words_of.items()}
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {i: sum(linked(s, t) for j, t in sets.items() if j != i) for i, s in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == want
    assert made[0].count() < 200  # pairs of the 50 near copies: 1,225

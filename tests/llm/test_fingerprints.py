"""Order MinHash fingerprints, token alignment and whitening."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from themeloom.llm import aligning, order_minhash, whitening
from themeloom.llm.inputs import table
from themeloom.llm.vocabularies import VocabularyFiles, load

DOC = "doc_id long, text string, number int, signature string"
ODD = [
    (None, None, 1, "x"), (None, "", 1, "x"), (3, "", 1, "x"), (3, "one two", 1, "x"), (3, "one two", 2, "y"),
    (9, "漢字かな交じり文 ไทย", 1, "x"), (1 << 62, "a" * 70 + " b\r\n\tc", 1, None), (-4, "z " * 3000, 1, "x"),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOC)


# ------------------------------------------------------------------ order MinHash


def split(text):
    alone = "฀-๿぀-ヿ㐀-鿿"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [p for w in words for p in re.findall(f"[{alone}]|[^{alone}]{{1,32}}", w)]


def edited(docs):
    """doc_id -> (length, edited text, next text) by falling id; ids are distinct."""
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        out[doc_id] = (len(text), text[: len(text) - half] + after[:half], after)
    return out


def tuples(spark, texts, by=order_minhash.OrderMinHash()):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = order_minhash.with_signature(rows, "text", "s", by).orderBy("i").collect()
    return [r.s for r in got]


def test_edited_texts_and_equal_fingerprints(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    rows = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = edited(list(texts.items()))
    assert len(rows) == len(texts)
    by_text = {}
    for doc_id, (n, changed, after) in want.items():
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        by_text.setdefault(texts[doc_id], set()).add(r.fingerprint)
        by_text.setdefault(changed, set()).add(r.edited_fingerprint)
        parts = [x[i : i + 8] for x in (r.fingerprint, r.edited_fingerprint) for i in range(0, 512, 8)]
        assert r.near_edited == sum(a == b for a, b in zip(parts[:64], parts[64:])) / 64
        if after == texts[doc_id]:
            assert r.near_next == 1
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited for r in rows.values()]) > 0.08


def test_signature_selects_by_ring_and_keeps_text_order(spark):
    """Against a plain version that knows the hash of each k-mer, but not the ring."""
    by = order_minhash.OrderMinHash(k=2, l=2, point_bits=4)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (2, 3, 5, 9, 40, 200, 200)]
    texts += [texts[-1], "a a a a a a a", "b"]
    got = tuples(spark, texts, by)
    assert got[6] == got[7] and got[5] != got[6]

    def hashes(text):
        words = split(text)
        grams = [tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))]
        seen, numbered = Counter(), []
        for gram in grams:
            numbered.append((gram, seen[gram]))
            seen[gram] += 1
        frame = spark.createDataFrame([(list(g), n) for g, n in numbered], "g array<string>, n int")
        from pyspark.sql import functions as F

        word = F.transform("g", lambda w: F.xxhash64(w))
        gram = F.xxhash64(F.get(word, F.lit(0)), F.get(word, F.lit(1)))
        ring = F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(gram, 28), "n"), 28)
        return [r[0] for r in frame.select(ring).collect()]

    for text, signature in zip(texts, got):
        ring = hashes(text)
        # Unsigned 36-bit places; the ring starts at the smallest signed number.
        at = sorted(range(len(ring)), key=lambda i: (ring[i] + (1 << 35)) % (1 << 36))
        place = [(ring[i] + (1 << 35)) % (1 << 36) for i in at]
        chosen = []
        for point in range(16):
            first = next((j for j, p in enumerate(place) if p >= point << 32), 0)
            picked = {at[(first + j) % len(at)] for j in range(2)}
            chosen.append(tuple(ring[i] for i in sorted(picked)))
        for a in range(16):
            for b in range(a):
                assert (chosen[a] == chosen[b]) == (signature[a] == signature[b])


def test_likeness_falls_with_edits_and_with_moved_parts(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]

    def near(other):
        a, b = tuples(spark, [" ".join(words), " ".join(other)], order_minhash.OrderMinHash(point_bits=9))
        return np.mean([x == y for x, y in zip(a, b)])

    few = [w if i % 100 else "new" for i, w in enumerate(words)]
    many = [w if i % 20 else "new" for i, w in enumerate(words)]
    assert 1 > near(few) > near(many) > 0.3
    # Moved parts keep nearly all k-mers, so the set of k-mers hardly changes.
    moved = words[300:] + words[:300]
    assert 0.3 < near(moved) < 0.7
    assert near([f"v{w}" for w in words]) == 0


def test_fingerprints_of_odd_rows(spark):
    rows = order_minhash.fingerprints(odd(spark)).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r.n_chars == 0]
    assert len({r.fingerprint for r in empty}) == 1 and len(empty) == 3
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert len({(r.fingerprint, r.near_edited, r.near_next, r.edited_sha256) for r in rows if r.n_chars == 7}) == 1
    assert order_minhash.fingerprints(odd(spark).limit(0)).count() == 0
    alone = order_minhash.fingerprints(odd(spark).filter("doc_id = 9")).first()
    assert alone.near_next == 1


def test_very_long_text(spark):
    rng = random.Random(0)
    text = " ".join(f"w{rng.randrange(2000)}" for _ in range(200_000))
    rows = order_minhash.fingerprints(spark.createDataFrame([(1, text), (2, text + " end"), (3, "x" * 300_000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[2].near_next > 0.9 and got[1].n_chars == len(text)


# ------------------------------------------------------------------ token alignment


def plain_alignment(docs, files):
    """Everything from sets of ends, with the other library for the byte-level file."""
    a, b = load(files)
    model = sentencepiece.SentencePieceProcessor(model_file=f"{files.folder}/{files.pieces}")
    coder = Tokenizer.from_file(f"{files.folder}/{files.byte_level}")
    coder.encode_special_tokens = True
    links, out = [], []
    for _, text in docs:
        spaced = " " + (text or "")
        x = coder.encode(spaced, add_special_tokens=False).ids if text else []
        y = model.encode(text) if text else []
        if not text or a.spell(x) != spaced.encode() or b.spell(y) != spaced.encode():
            x = y = []
        ends = [np.cumsum([len(v.tokens[i]) for i in ids]).tolist() for v, ids in ((a, x), (b, y))]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for end in shared:
            to = [e.index(end) + 1 for e in ends]
            groups.append((x[at[0] : to[0]], y[at[1] : to[1]]))
            at = to
        links.append([(g[0][-1], g[1][-1]) for g in groups])
        out.append((len(x), len(y), groups))
    counts = Counter(p for doc in links for p in doc)
    most = {}
    for (_, right), n in counts.items():
        most[right] = max(most.get(right, 0), n)
    rows = []
    for (doc_id, _), (n_a, n_b, groups), pairs in zip(docs, out, links):
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in pairs)
        rows.append((doc_id, n_a, n_b, len(groups), len(pairs), best, sum(counts[p] for p in pairs), digest))
    return rows


@pytest.mark.parametrize("part_bytes", [1, 20_000, 8 << 20])
def test_alignment_equals_plain_version(spark, tiny, part_bytes):
    files = VocabularyFiles()
    docs = table(spark, tiny, "documents").select("doc_id", "text").limit(80)
    strange = [
        (-1, "<|endoftext|> <s> </s> <unk>"), (-2, "▁under▁"), (-3, "\n\n\t x\u0000   é é 🙂🙂"),
        (-4, " two  spaces   three "), (-7, "   "), (-8, "a\u00a0b  "), (-9, "x ▁ y"), (-5, "a" * 5000), (-6, "漢字" * 300),
    ]
    docs = docs.union(odd(spark).select("doc_id", "text")).union(spark.createDataFrame(strange, docs.schema))
    got = aligning.alignment(docs, files, part_bytes)
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], files)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_of_empty_tables(spark):
    assert aligning.alignment(odd(spark).limit(0)).count() == 0
    only = aligning.alignment(odd(spark).filter("doc_id IS NULL")).collect()
    assert [tuple(r) for r in only] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_aligned_ids_give_the_bytes_back(spark, tiny):
    a, b = load(VocabularyFiles())
    docs = table(spark, tiny, "documents").limit(20)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in aligning.aligned(docs).collect():
        assert a.spell(r.a_ids) == b.spell(r.b_ids) == (" " + texts[r.doc_id]).encode()
        for p, q in zip(r.a_cuts, r.b_cuts):
            assert a.spell(r.a_ids[:p]) == b.spell(r.b_ids[:q])
        assert (r.a_cuts[-1], r.b_cuts[-1]) == (len(r.a_ids), len(r.b_ids))


def lengths(ends, kind):
    found = [b - a for a, b in zip([0, *ends], ends)]
    return bytes(found) if kind is bytes else found


@pytest.mark.parametrize("kind", [bytes, list])
def test_runs_jump_and_resolve(kind):
    def cut(a, b):
        return [tuple(r) for r in aligning.runs(lengths(a, kind), lengths(b, kind)).tolist()]

    same = list(range(1, 1001))
    assert cut(same, same) == [(0, 1000, 0, 1000, 1)]
    assert cut([1, 2, 5, 9, 10], [1, 3, 5, 6, 9, 10]) == [(0, 1, 0, 1, 1), (1, 3, 1, 3, 0), (3, 4, 3, 5, 0), (4, 5, 5, 6, 1)]
    rng = random.Random(5)
    for _ in range(500):
        n = rng.randrange(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(n + 1)), n}) for _ in range(2))
        found = cut(a, b)
        cuts = [e for a0, a1, _, _, one in found for e in (a[a0:a1] if one else a[a1 - 1 : a1])]
        assert cuts == sorted(set(a) & set(b))
        assert all(x[1] == y[0] and x[3] == y[2] for x, y in zip(found, found[1:]))


# ------------------------------------------------------------------ whitening


def plain_whitening(rows):
    """vec_id -> (n, deviation, whitened, explained) with numpy and whole numbers."""
    whole = [(i, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    matrix = np.array([[v - s / n for v, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(matrix.T @ matrix / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in whole:
        centred = np.array([v - s / n for v, s in zip(x, sums)])
        deviation = sum((n * v - s) ** 2 for v, s in zip(x, sums))
        out.append((i, n, deviation, centred @ axes[:, :4] / np.sqrt(values[:4]), values[:4] / values.sum()))
    return out


def test_whitening_equals_plain_version(spark, tiny):
    rows = table(spark, tiny, "embeddings")
    again = rows.limit(3).union(rows.limit(3)).withColumn("x", rows.label)
    rows = rows.withColumn("x", rows.label).union(again)
    got = whitening.whiten(rows).collect()
    want = plain_whitening([(r.vec_id, r.embedding) for r in rows.collect()])
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
        assert r.identity_error < 1e-10
    assert len(got) == 4 * len(want)
    for i, n, deviation, whitened, explained in want:
        for r in by_row[i]:
            j = r.component - 1
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(r.explained / explained[j] - 1) < 1e-9
            sign = signs.setdefault(j, np.sign(r.whitened * whitened[j]))
            assert r.whitened == pytest.approx(sign * whitened[j], abs=1e-8)


def test_whitening_over_many_blocks(spark, tiny, monkeypatch):
    rows = table(spark, tiny, "embeddings")
    whole = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(rows).collect()}
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 24)
    for r in whitening.whiten(rows).collect():
        assert abs(abs(r.whitened) - abs(whole[r.vec_id, r.component])) < 1e-8


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [nan, 1.0]), (3, None), (4, [None, 1.0]), (5, []), (6, [3.0, 5.0, 7.0]),
        (7, [2.0, 2.0]), (8, [inf, 0.0]), (8, [0.5, -0.001]), (9, [-0.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, x int, row string")
    got = whitening.whiten(frame).collect()
    want = plain_whitening([r for r in rows if r[0] in (None, 1, 7, 9) or r[1] == [0.5, -0.001]])
    assert Counter((r.vec_id, r.n, r.deviation) for r in got) == Counter({(i, n, d): 2 * k for (i, n, d), k in Counter(w[:3] for w in want).items()})
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id = 1")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}

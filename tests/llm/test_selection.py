"""Quality rules, mixing and packing."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from themeloom.llm import mixing, packing, quality
from themeloom.llm.inputs import table


def test_surface_rules(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "a b\na b\n \n \na b"), (-4, "Ä|# <x>\n" * 40), (-4, "Ä|# <x>\n" * 40)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    got = quality.verdicts(docs, table(spark, tiny, "labels")).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((i, *brute.rules(t)) for i, t in texts)
    assert sorted(tuple(r)[:7] for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_good_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = quality.verdicts(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(junk) < 0.3
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.verdicts(docs, labels).filter("kept").count()


def test_rejection_rates_agree_across_sizes(spark):
    rates = {}
    for size in ("sf0.01", "sf0.1"):
        docs, labels = (table(spark, f"/root/testdata/{size}", name) for name in ("documents", "labels"))
        rows = quality.verdicts(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
        rates[size] = [np.mean([not r.kept for r in rows if r.quality == q]) for q in (0, 1)]
    (bad, good), (bad_l, good_l) = rates["sf0.01"], rates["sf0.1"]
    assert min(bad, bad_l) > 0.95 and max(good, good_l) < 0.01 and abs(bad - bad_l) < 0.05


def test_scores_leave_the_own_text_out(spark):
    """Against exact counts of distinct texts, without the text's own."""
    texts = ["a b c", "a b d d", "a b c", "c d a", None, "z z", ""]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "c d a")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    own = {t: Counter(brute.words(t) + list(zip(brute.words(t), brute.words(t)[1:]))) for t in texts if t}
    trusted, prior = {"a b c", "c d a"}, quality.QualitySettings().prior
    share = sum(own[t].total() for t in trusted) / sum(c.total() for c in own.values())
    for row in quality.verdicts(docs, labels).collect():
        text, want = texts[row.doc_id], 0.0
        for gram, n in own.get(text, {}).items():
            others = [t for t in own if t != text]
            good = sum(own[t][gram] for t in others if t in trusted)
            want += n * np.log((good / share + prior) / (sum(own[t][gram] for t in others) + prior))
        assert row.score == pytest.approx(want / max(row.n_grams, 1), abs=1e-8)


def test_scores_do_not_depend_on_bundles_and_slices(spark, monkeypatch):
    """Many bundles and slices give the scores of one, and no row for each text and slice."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghij\u00e4\u4e2d", k=rng.randint(0, 90))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 160, 3)], "doc_id long, quality int, toxic int")
    want = {r.doc_id: r for r in quality.verdicts(docs, labels).collect()}
    monkeypatch.setattr(quality, "SLICE", 200)
    got = {r.doc_id: r for r in quality.verdicts(docs, labels).collect()}
    assert got.keys() == want.keys() and len({r.score for r in want.values()}) > 60
    assert all(got[i].score == pytest.approx(want[i].score, abs=2e-9) and got[i].kept == want[i].kept for i in want)
    same = quality.text_classes(quality.surface(docs, quality.QualitySettings()), quality.trusted_ids(labels))
    for parts in (2, 8):
        held = quality.bundles_of(docs, same, 4)
        assert quality.questions(held, parts).count() <= 4 * parts


def test_quality_without_rows_or_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, raw string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.verdicts(docs, labels).count() == 0 and quality.keep_good(docs, labels).count() == 0
    one = spark.createDataFrame([(None, "w " * 60, "r"), (1, " ".join(map(str, range(60))), "r")], docs.schema)
    assert {(r.doc_id, r.score, r.kept) for r in quality.verdicts(one, labels).collect()} == {(None, 0.0, False), (1, 0.0, True)}


def test_margins_follow_targets(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = mixing.sample(docs).toPandas()
    assert len(rows) == docs.count()
    for margin in mixing.MARGINS:
        sums = rows.groupby(margin).agg(tokens=("n_tokens", "sum"), weight=("weight", "sum"))
        goal = sums.tokens**0.7 / (sums.tokens**0.7).sum()
        assert np.allclose(sums.weight, goal, rtol=0.02, atol=1e-6)
    drawn = rows.n_tokens[rows.selected].sum() / rows.n_tokens.sum()
    expected = (rows.n_tokens * rows.probability).sum() / rows.n_tokens.sum()
    assert abs(expected - 0.8) < 0.01 and abs(drawn - expected) < 0.1
    again = mixing.sample(docs).toPandas()
    assert set(again.doc_id[again.selected]) == set(rows.doc_id[rows.selected])
    assert mixing.keep_sample(docs).count() == rows.selected.sum()


def test_given_targets_and_odd_rows(spark):
    text = "red red blue green"
    data = [(1, text, "a", "en"), (2, text, None, "en"), (3, None, "a", None), (4, "", "b", "de"), (None, text, "b", "en"), (5, text, "a", "en"), (5, text, "a", "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, source string, lang string, weight double")
    cells = mixing.cells_of(mixing.describe(docs, mixing.MixSettings()))
    targets = mixing.flat_targets(cells, 1.0)
    wanted = [("=a", 1.0), ("=b", 1.0), ("null", 2.0), ("=absent", 5.0)]
    targets["source"] = spark.createDataFrame(wanted, "source string, target double")
    rows = mixing.sample(docs, targets).toPandas()
    assert len(rows) == 7
    sums = rows.groupby(rows.source.fillna("null")).weight.sum()
    assert np.allclose([sums["a"], sums["b"], sums["null"]], [0.25, 0.25, 0.5], atol=1e-3)
    assert set(rows.topic[rows.n_tokens == 0]) == {-1}
    assert mixing.sample(docs.limit(0)).count() == 0 and mixing.keep_sample(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(0, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 11))}
    lengths = sorted(histogram)
    for buckets in (1, 2, 3, 5):
        bounds = packing.best_bounds(lengths, [histogram[x] for x in lengths], buckets)
        assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == lengths[-1]
        cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in histogram.items())
        assert cost == brute.least_padding(histogram, buckets)


def test_batches_keep_the_budget(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text", "source")
    odd = [(-1, None, "x"), (-2, "", "x"), (None, "a b", "x"), (-3, "w " * 20_000, "x"), (-4, "a b", "x"), (-4, "a b", "x")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = packing.pack(docs, packing.PackSettings(buckets=6, budget=4096)).toPandas()
    assert len(rows) == docs.count()
    texts = {r.doc_id: len(brute.words(r.text)) for r in docs.collect()}
    assert all(texts[None if np.isnan(d) else int(d)] == n for d, n in zip(rows.doc_id, rows.n_tokens, strict=True))
    assert (rows.padding == rows.bucket - rows.n_tokens).all() and (rows.padding >= 0).all()
    batches = rows.groupby(["bucket", "batch"]).slot.agg(["count", "nunique", "max"]).reset_index()
    assert (batches["count"] == batches["nunique"]).all() and (batches["max"] == batches["count"] - 1).all()
    assert ((batches.bucket * batches["count"] <= 4096) | (batches["count"] == 1)).all()
    full = batches.sort_values("batch").groupby("bucket")["count"]
    assert all((g.iloc[:-1] == g.iloc[0]).all() for _, g in full)
    assert packing.pack(docs.limit(0)).count() == 0

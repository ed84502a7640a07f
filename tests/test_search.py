"""The trigram index against a scan of all rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.operators import explore, textindex
from themeloom.plans import catalog


@pytest.mark.parametrize("pattern, need", [
    ("abc", [{"abc"}]),
    ("ab", None),
    ("a.c", None),
    ("abcd|xyz", [{"abc", "bcd"}, {"xyz"}]),
    ("abcd|x", None),
    ("th(e|at) .*with", [{"the", "he ", "wit", "ith"}, {"tha", "hat", "at ", "wit", "ith"}]),
    ("(foo)+bar", [{"foo", "bar"}]),
    ("(foo)?barn", [{"bar", "arn"}]),
    ("[ab]cd", [{"acd"}, {"bcd"}]),
    (r"^ÉMENT\b", [{"\u0001me", "men", "ent"}]),
    ("KİLO", [{"kil", "ilo"}]),
    (r"\p{L}abc", None),
    ("[a-z&&[^b]]abc", None),
    ("abc(?=def)x", [{"abc", "bcx"}]),
    ("colou?r", [{"col", "olo"}]),
    ("x{3}yyyy", [{"yyy"}]),
    ("(?<name>abc)", None),
    ("ab(", None),
])
def test_what_a_pattern_demands(pattern, need):
    found = textindex.required(pattern)
    assert (found if found is None else sorted(map(sorted, found))) == (need if need is None else sorted(map(sorted, need)))


TEXTS = [
    "The quick brown Fox", "that was with", "THE END\nwithout", None, "", "ab", "ſtop the Kelvin", "STOP", "İstanbul kilo",
    "ı e m e n t éMENT", "Élément 🙂🙂🙂", "straße STRASSE", "a" * 5000, "x\u0001me", "abc", "zabcdz",
]


def test_search_equals_scan(spark, tmp_path):
    rows = [(i, f"s:{i}", t, "s", "t", 1.0, 0.0, None) for i, t in enumerate(TEXTS * 20)]
    df = spark.createDataFrame(
        rows, "seq long, id string, text string, source string, theme string, rating double, sentiment double, timestamp timestamp"
    )
    index = textindex.TextIndex.build(df, str(tmp_path / "index"), block_rows=7)
    for pattern in [
        "the", "th(e|at) .*with", "stop", "kilo", "éMENT", "ement", "KELVIN", "istan", "🙂🙂🙂", "strasse", "straße", "aaaa",
        "ab", "^$", "abc|quick", "(?<x>abc)", "nothing like it", "without|zab", "a.c",
    ]:
        want = sorted(r.id for r in explore.search(df, pattern).collect())
        fetched = index.fetch(spark, pattern)
        assert sorted(r.id for r in explore.search(fetched, pattern).collect()) == want, pattern
        assert fetched.columns == df.columns
    assert index.fetch(spark, "quick brown").count() == 20
    assert index.fetch(spark, "nothing like it").count() == 0
    assert index.fetch(spark, "ab").count() == len(rows)


def test_trigrams_are_listed_in_pieces(monkeypatch):
    """Of each block, a bounded number of bytes at once; together, what ``_fold`` demands."""
    monkeypatch.setattr(textindex, "LIST_BYTES", 200)
    texts = [t or "" for t in TEXTS] * 3
    blocks, rows = [i // 20 for i in range(len(texts))], [i % 20 for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(rows, pa.int32()), pa.array(texts)], ["block", "_row", "text"])
    found = [(x["gram"], x["block"], r) for out in textindex._lists(iter([batch, batch.slice(7, 30)])) for x in out.to_pylist() for r in x["rows"]]
    every = list(zip(blocks, rows, texts))
    want = [(g, b, r) for b, r, t in every + every[7:37] for g in textindex._trigrams(textindex._fold(t))]
    assert sorted(found) == sorted(want)
    longest = max(len(textindex._fold(t)) for t in texts)
    assert all(len(x.column(2).flatten()) <= max(200, longest) for x in textindex._lists(iter([batch])))


def test_postings_of_a_block_are_in_lists_of_bounded_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "LIST_BYTES", 1000)  # travels to the workers by value
    monkeypatch.setattr(textindex, "LEAST_BLOCKS", 1)
    df = spark.createDataFrame([(i, f"common words {i}") for i in range(400)], "seq long, text string")
    index = textindex.TextIndex.build(df, str(tmp_path / "index"), block_rows=10**6)
    sizes = spark.read.parquet(index.postings).agg(F.max(F.size("rows")).alias("most")).first()
    assert spark.read.parquet(index.rows).select("_block").distinct().count() == 1 and 50 < sizes.most <= 1000 // 14
    assert index.fetch(spark, "mon wor").count() == 400 and index.fetch(spark, "words 39").count() == 11


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    rows = [(i, "common words " + ("needle" if i in (5, 901) else "straw")) for i in range(1000)]
    index = textindex.TextIndex.build(spark.createDataFrame(rows, "seq long, text string"), str(tmp_path / "index"))
    found = index.fetch(spark, "need.e")
    assert sorted(r.seq for r in found.collect()) == [5, 901]
    need = textindex.required("need.e")
    blocks = {r.block for r in index.candidates(spark, need).collect()}
    stored = spark.read.parquet(index.rows)
    assert len(blocks) == 2 and stored.select("_block").distinct().count() > 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_block" in plan.replace("isnotnull(", "")


def test_indexed_queries(spark, tiny):
    for name in ("search", "search_unicode"):
        scan = catalog.QUERIES[name](spark, tiny)
        fast = catalog.QUERIES[f"{name}_indexed"](spark, tiny)
        assert scan.columns == fast.columns and scan.exceptAll(fast).count() == fast.exceptAll(scan).count() == 0
        assert scan.count() > 0
    # Of all rows, only those that may match are fetched.
    pattern, everything = "erschen|ientes", catalog._themed(spark, tiny)
    fetched = catalog._index(spark, tiny).fetch(spark, pattern)
    found = F.col("text").rlike(f"(?iu){pattern}")
    assert fetched.filter(found).count() == everything.filter(found).count()
    assert fetched.count() < everything.count()

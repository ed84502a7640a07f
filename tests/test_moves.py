"""How often rows move and how large they are written."""

from pyspark.sql import functions as F

from themeloom.operators import embed, language, textindex
from themeloom.plans import catalog
from themeloom.runtime import stage
from themeloom.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_rows_spread_by_a_key_move_once(spark):
    rows = spark.range(0, 40, 1, 1).select((F.col("id") % 30).alias("k"), F.col("id").cast("string").alias("text"))
    other = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = readers.spread(rows, "k").join(other, "k", "left").join(other.toDF("k", "w"), "k", "left")
        assert plan(joined).count("Exchange ") == 3  # the rows once, each other side once
        assert joined.count() == 40 and joined.filter("v IS NULL").count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_staged_tables_are_packed_tightly(spark):
    held = stage(spark.range(10).select(F.col("id").cast("string").alias("text")))
    assert all(".zstd." in name for name in held.inputFiles()) and held.count() == 10


def test_trigrams_are_counted_where_they_are_taken(spark):
    df = spark.createDataFrame([(1, "abab"), (1, "ab"), (None, "x")], "k long, text string")
    found = language.trigrams(df, "text")
    steps = plan(found)
    assert steps.count("Exchange ") == 1 and steps.index("Generate ") < steps.index("Exchange ")
    rows = {(r.k, r.gram): r.n for r in found.collect()}
    assert rows[(1, "_ a b")] == 2 and rows[(1, "a b a")] == 1 and rows[(None, "_ x _")] == 1


def test_weights_do_not_move_to_the_rarities(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a c")], "seq long, text_clean string")
    found = embed.term_weights(df)
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    assert {(r.seq, r.term): round(r.weight, 4) for r in found.collect()} == {
        (1, "a"): 0.0, (1, "b"): 1.0, (2, "a"): 0.0, (2, "c"): 1.0
    }


def test_index_holds_every_row_and_what_a_search_returns(spark, tiny, tmp_path):
    rows = [(None, "none such"), *[(i // 2, f"text {i} such") for i in range(50)]]  # keys twice, and one missing
    index = textindex.TextIndex.build(spark.createDataFrame(rows, "seq long, text string"), str(tmp_path / "index"), block_rows=7)
    assert sorted(r.text for r in index.fetch(spark, "such").collect()) == sorted(t for _, t in rows)
    places = spark.read.parquet(index.rows)
    assert places.select("_block", "_row").distinct().count() == len(rows)
    held = spark.read.parquet(catalog._index(spark, tiny).rows)
    assert "text" in held.columns and not {"text_clean", "embedding"} & set(held.columns)

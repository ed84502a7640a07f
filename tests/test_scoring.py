import math

import pytest
from pyspark.sql import functions as F

from themeloom.functions import measures
from themeloom.operators import cleaning, explore, scoring

SCHEMA = ("id string, seq long, source string, cluster_id int, rating double, sentiment double, "
          "age_days double, is_near_dup boolean")


def frame(spark, n=20, cluster=0, rating=2.0, sentiment=-0.5, age=1.0, sources=("a", "b"), dups=0):
    rows = [
        (f"{cluster}:{i}", cluster * 1000 + i, sources[i % len(sources)], cluster, rating, sentiment, age, i < dups)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def score(spark, df, severity=3, cohesion=0.6, settings=scoring.ScoreSettings()):
    ids = df.select("cluster_id").distinct()
    out = scoring.score_clusters(
        df, ids.withColumn("severity", F.lit(severity)), ids.withColumn("cohesion", F.lit(cohesion)), settings)
    return {r.cluster_id: r for r in out.collect()}


def wilson(spark, k, n, level=0.95):
    low, high = measures.wilson_bounds(F.lit(k), F.lit(n), level)
    row = spark.range(1).select(low.alias("l"), high.alias("h")).head()
    return row.l, row.h


def test_wilson(spark):
    assert wilson(spark, 0, 0) == (0.0, 1.0)
    small, large = wilson(spark, 3, 4), wilson(spark, 75, 100)
    assert small[1] - small[0] > large[1] - large[0]
    for k, n in ((0, 10), (10, 10), (5, 7), (1, 2)):
        low, high = wilson(spark, k, n)
        assert 0 <= low <= k / n <= high + 1e-12 and high <= 1
    narrow, wide = wilson(spark, 5, 10, 0.90), wilson(spark, 5, 10, 0.99)
    assert wide[0] < narrow[0] < narrow[1] < wide[1]


def test_recency(spark):
    df = spark.createDataFrame([(1, 90.0), (2, 0.0), (3, None)], "cluster_id int, age double")
    rows = df.groupBy("cluster_id").agg(
        F.coalesce(F.avg(measures.decay(F.col("age"), 90.0)), F.lit(0.5)).alias("r")).collect()
    got = {r.cluster_id: r.r for r in rows}
    assert got[1] == pytest.approx(0.5) and got[2] == 1.0 and got[3] == 0.5


def test_components_sum_to_priority(spark):
    row = score(spark, frame(spark))[0]
    parts = [c.contribution for c in row.score_components]
    assert row.priority_score == pytest.approx(sum(parts), abs=1e-9)
    assert [c.name for c in row.score_components] == ["frequency", "severity", "recency", "source_diversity"]
    sev = 0.5 * 0.5 + 0.3 * 0.75 + 0.2 * 0.5
    assert row.score_components[1].normalized == pytest.approx(round(sev, 4))
    assert row.score_components[0].normalized == 1.0
    assert row.score_components[3].normalized == pytest.approx(1.0)


def test_severity_raises_priority(spark):
    low, high = score(spark, frame(spark), 1)[0], score(spark, frame(spark), 5)[0]
    assert high.priority_score > low.priority_score


def test_unrated_cluster_folds_weights(spark):
    row = score(spark, frame(spark, rating=None))[0]
    assert row.score_components[1].normalized == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)


def test_badges_and_confidence(spark):
    df = frame(spark, 3, 0).unionByName(frame(spark, 10, 1)).unionByName(frame(spark, 30, 2, dups=4))
    got = score(spark, df, cohesion=0.2)
    assert [got[i].confidence.badge for i in range(3)] == ["insufficient_evidence", "low_sample", "ok"]
    assert got[2].confidence.n_unique == 26 and got[2].confidence.mixed_theme_warning
    assert got[2].confidence.negative_share == 1.0
    assert got[0].n_largest == 30


def test_single_source_and_unknown_ages(spark):
    row = score(spark, frame(spark, 8, sources=("only",), age=None))[0]
    assert row.d_norm == 0.0 and row.r_norm == 0.5


def test_source_age_and_noise(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-03', -1), ('a', timestamp'2024-01-01', 0),"
        " ('b', null, 0), ('b', null, -1) t(source, timestamp, cluster_id)")
    ages = sorted((r.source, r.age_days) for r in scoring.add_source_age(df).filter("source='a'").collect())
    assert ages == [("a", 0.0), ("a", 2.0)]
    assert scoring.add_source_age(df).filter("source='b' and age_days is not null").count() == 0
    stats = scoring.noise_stats(df.withColumn("from_noise", F.lit(False))).head()
    assert (stats.n_clusters, stats.noise_share) == (1, 0.5)


def test_severity_prior(spark):
    prior = measures.severity_prior(F.col("r"), F.col("s"))
    rows = spark.createDataFrame([(1.0, -0.5), (5.0, 0.9), (None, -0.4), (None, 0.4)], "r double, s double")
    got = [r[0] for r in rows.select(prior).collect()]
    assert got == pytest.approx([0.7 + 0.15, 0.0, 0.4, 0.0])


def test_exact_copies(spark):
    df = spark.createDataFrame(
        [(1, "App keeps crashing"), (0, "app keeps crashing"), (2, "Love it")], "seq long, text_clean string")
    assert sorted(r.seq for r in cleaning.drop_exact_copies(df).collect()) == [0, 2]
    assert cleaning.exact_copy_count(df).head().n_copies == 1
    flags = {r.seq: r.is_near_dup for r in cleaning.flag_copies(df).collect()}
    assert flags == {0: False, 1: True, 2: False}


def test_clean_stats_and_language_switch(spark):
    df = spark.createDataFrame(
        [("x", "en"), ("long enough text", "en"), ("assez de texte ici", "fr"), ("123456789012345678", None)],
        "text_clean string, lang string")
    got = cleaning.clean_stats(cleaning.tag_drops(df, 15, "en")).head()
    assert tuple(got) == (4, 1, 2, 1)
    assert cleaning.clean_stats(cleaning.tag_drops(df, 15, "fr")).head().dropped_wrong_language == 0


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)], "g string, v double")
    bins = {r.bin: r.n for r in explore.histogram(df, F.col("v"), 50).collect()}
    assert bins[1] == 2 and bins[50] == 3 and sum(bins.values()) == 101
    row = explore.describe_by(df, "g", "v").head()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["p75"]) == (101, 50.0, 25.0, 50.0, 75.0)
    assert row["std"] == pytest.approx(math.sqrt(sum((i - 50) ** 2 for i in range(101)) / 100))


def test_fold_search_and_turns(spark):
    rows = [(i, f"t{i % 4}" if i % 4 else None, "Crash on start" if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "cluster_id int, theme string, text string")
    themed = df.fillna({"theme": explore.UNCLUSTERED})
    folded = {r.theme_view: r["count"] for r in explore.fold_themes(themed, 2).groupBy("theme_view").count().collect()}
    assert folded == {"t1": 5, "t2": 5, explore.OTHER: 5, explore.UNCLUSTERED: 5}
    full = themed.selectExpr("cast(cluster_id as string) id", "text", "'s' source", "theme", "1d rating",
                             "0d sentiment", "timestamp'2024-01-01' timestamp")
    assert explore.search(full, "^cr.sh").count() == 10
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(9)],
                                  "conv_id long, turn long, role string, text string")
    assert explore.last_turns(turns).head().history.split("\n") == [
        "Analyst: m3", "PM: m4", "Analyst: m5", "PM: m6", "Analyst: m7", "PM: m8"]

"""Cases that once gave wrong answers or crashed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scoring import frame
from themeloom.operators import explore, neardup, scoring
from themeloom.sources import readers


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "seq long, text_clean string")


def test_largest_cluster_counts_when_its_annotation_failed(spark):
    df = frame(spark, 100, 0).unionByName(frame(spark, 10, 1))
    cohesion = spark.createDataFrame([(0, 0.5), (1, 0.5)], "cluster_id int, cohesion double")
    both = spark.createDataFrame([(0, 3), (1, 3)], "cluster_id int, severity int")
    full = {r.cluster_id: r.priority_score for r in scoring.score_clusters(df, both, cohesion).collect()}
    part = scoring.score_clusters(df, both.filter("cluster_id = 1"), cohesion).collect()
    assert [(r.cluster_id, r.priority_score, r.n_largest) for r in part] == [(1, full[1], 100)]


def test_clusters_beyond_forty_are_scored(spark):
    rows = spark.range(45).selectExpr("cast(id as int) AS cluster_id", "explode(sequence(1, 2)) AS i")
    assert scoring.top_clusters(rows).count() == 45 and scoring.top_clusters(rows, 3).count() == 3


@pytest.mark.parametrize("rows", [[], ["one text"], ["a b c", "c b a"], ["same same", "same"]])
def test_text_flags_of_tiny_corpora(spark, rows):
    assert neardup.flag_text(texts(spark, rows)).count() == len(rows)


def test_search_folds_case_of_all_letters(spark):
    rows = spark.createDataFrame([("1", "Die ÜBERWEISUNG fehlt"), ("2", "nichts")], "id string, text string")
    rows = rows.selectExpr("id", "text", "'s' source", "'t' theme", "1.0 rating", "0.0 sentiment", "now() timestamp")
    assert [r.id for r in explore.search(rows, "überweisung").collect()] == ["1"]


def test_csv_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("review,rating\ngood,5\n")
    assert readers.read_csv(spark, str(tmp_path)).head().review == "good"
    (tmp_path / "two.csv").write_text("rating,review\n1,bad app\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_rows_without_a_vector_stay(spark):
    from themeloom.plans.flow import FlowSettings, prepare

    rng = np.random.default_rng(1)
    rows = [(f"s:{i}", i, "s", f"text number {i} about topic {i % 2} and more", None, None, None) for i in range(40)]
    schema = "id string, seq long, source string, text string, rating double, timestamp timestamp, author_hash string"
    lexicon = spark.createDataFrame([("about", 1.0)], "word string, valence double")
    vectors = {i: rng.normal(size=4).tolist() for i in range(35)}

    def some(df):
        table = spark.createDataFrame([(i, v) for i, v in vectors.items()], "seq long, embedding array<float>")
        return df.select("seq").join(table, "seq", "left")

    corpus, _ = prepare(spark.createDataFrame(rows, schema), lexicon, FlowSettings(), embed_fn=some)
    got = {r.seq: r.cluster_id for r in corpus.select("seq", "cluster_id").collect()}
    assert len(got) == 40 and all(got[i] == -1 for i in range(35, 40))
    assert corpus.filter(F.col("cluster_id").isNull()).count() == 0

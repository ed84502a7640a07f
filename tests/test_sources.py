import pytest
from pyspark.sql import functions as F

from themeloom.functions import coerce, text
from themeloom.sources import adapters, raw, readers, sinks


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_clean_text(spark):
    cases = {
        "@Some_Team app broken see https://x.co/abc now": "app broken see now",
        "a   b\n\nc": "a b c",
        "www.site.org/x?y=1 fine": "fine",
        "great 🙂️ app": "great app",
        "½ ② née 中文 ok": "½ ② née 中文 ok",
        "a b": "a b",
        "50% off (really!) & more": "50% off (really!) & more",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), text.clean_text) == list(cases.values())


def test_slug_and_title(spark):
    assert column(spark, ["My Data! 2", "***", "a--b"], text.slug) == ["my-data-2", "upload", "a-b"]
    assert column(spark, ["App Review"], lambda c: text.slug(c, "_")) == ["app_review"]
    assert column(spark, ["insta_mock.csv"], text.dataset_title) == ["Insta Mock"]


def test_rating_coercion(spark):
    values = ["4", " 4 ", "abc", "", None, "7", "3.5", "NaN", "4d"]
    assert column(spark, values, coerce.rating) == [4.0, 4.0, None, None, None, 7.0, 3.5, None, None]
    assert column(spark, [float("nan"), 2.0], coerce.finite, "double") == [None, 2.0]


def test_time_coercion(spark):
    values = ["2024-05-06", "2024-05-06 07:08:09", "2024-05-06T07:08:09+02:00",
              "Tue Oct 31 22:10:47 +0000 2017", "soon", "", None]
    shown = column(spark, values, lambda c: F.date_format(coerce.timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert shown == ["2024-05-06 00:00:00", "2024-05-06 07:08:09", "2024-05-06 05:08:09",
                     "2017-10-31 22:10:47", None, None, None]


def test_review_csv(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        'reviewId,userName,content,score,at\n'
        'r1,Ann,"Two\nlines, ""quoted""",5,2024-01-02 03:04:05\n'
        'r2,,Bad rating,five,never\n'
        'r3,Bo,,1,2024-01-01\n', encoding="utf-8")
    raw_rows = readers.read_csv(spark, str(path)).withColumn("seq", F.substring("reviewId", 2, 9).cast("long"))
    rows = adapters.reviews(raw_rows, "seq").orderBy("seq").collect()
    assert [r.id for r in rows] == ["play_store_review:r1", "play_store_review:r2"]
    assert rows[0].text == 'Two\nlines, "quoted"' and rows[0].rating == 5.0
    assert rows[1].rating is None and rows[1].timestamp is None and rows[1].author_hash is None
    assert len(rows[0].author_hash) == 12 and rows[0].metadata == {"dataset_file": "reviews.csv"}


def test_review_id_falls_back_to_row(spark):
    df = spark.createDataFrame([(7, "fine app")], "seq long, review string")
    assert adapters.reviews(df, "seq").head().id == "play_store_review:row7"
    with pytest.raises(ValueError):
        adapters.reviews(spark.createDataFrame([(1, "x")], "seq long, words string"), "seq")


def test_ticket_contract(spark):
    with pytest.raises(ValueError, match="author_id"):
        adapters.tickets(spark.createDataFrame([(1, "x")], "tweet_id long, text string"), "tweet_id")
    df = spark.createDataFrame(
        [(1, "9", "Tue Oct 31 22:10:47 +0000 2017", "@help  my app @you fails ")],
        "tweet_id long, author_id string, created_at string, text string")
    row = adapters.tickets(df, "tweet_id").head()
    assert row.id == "support_ticket:1" and row.text == "my app  fails" and row.rating is None


def test_upload_mapping_and_cap(spark):
    assert adapters.map_upload_columns(["x", "comment", "Rating", "Date"]) == {
        "text": "comment", "rating": "Rating", "time": "Date"}
    assert adapters.map_upload_columns(["a", "b"])["text"] == "a"
    df = spark.createDataFrame([(i, f"t{i}", "3") for i in range(10)], "seq long, body string, score string")
    rows = adapters.upload(df, "seq", "App review", "body", "score", max_rows=4).orderBy("seq").collect()
    assert [r.id for r in rows] == [f"app_review:{i}" for i in range(4)]


def test_combine_keeps_first_source(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, review string")
    first = adapters.reviews(df, "seq")
    second = first.withColumn("text", F.lit("later"))
    assert {r.text for r in adapters.combine([first, second]).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        adapters.combine([])


@pytest.mark.parametrize("n,kept", [(10, 10), (1000, 500)])
def test_conversation_starters_switch(spark, n, kept):
    df = spark.range(n).withColumn("reply", F.when(F.col("id") % 2 == 1, F.col("id")))
    assert raw.conversation_starters(df, "reply").count() == kept


def test_mentions_and_recent(spark):
    df = spark.createDataFrame(
        [("True", "Hi @TeamCare"), ("False", "@teamcare"), ("true", None), (None, "@teamcare")],
        "inbound string, text string")
    assert raw.inbound_mentions(df, "@teamcare").count() == 1
    times = spark.createDataFrame([(1, None), (2, "2024"), (3, "2025")], "seq long, at string")
    assert [r.seq for r in raw.most_recent(times, 2).collect()] == [3, 2]


def test_sampling_is_partition_free(spark):
    df = spark.range(500).withColumn("id", F.col("id").cast("string"))
    one = {r.id for r in adapters.fixed_sample(df.coalesce(1), 50).collect()}
    assert one == {r.id for r in adapters.fixed_sample(df.repartition(7), 50).collect()} and len(one) == 50
    assert adapters.fixed_sample(df, 5000).count() == 500


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "corpus")
    sinks.write_corpus(spark.range(3), path, "one")
    sinks.write_corpus(spark.range(5), path, "two")
    sinks.write_corpus(spark.range(4), path, "one")
    assert [r.workspace for r in sinks.list_workspaces(spark.read.parquet(path)).collect()] == ["one", "two"]
    assert readers.read_corpus(spark, path, "one").count() == 4
    nested = spark.sql("select 1 as cluster_id, named_struct('a', array('x')) as analysis")
    sinks.write_insights(nested, str(tmp_path / "j"))
    assert readers.read_insights(spark, str(tmp_path / "j"), nested.schema).head().analysis.a == ["x"]
    sinks.write_csv(spark.sql("select 'say \"hi\", all' as t"), str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).head().t == 'say "hi", all'
    files = readers.list_files(spark, str(tmp_path), "*.csv").collect()
    assert len(files) == 1 and files[0].file_size > 0

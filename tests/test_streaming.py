import os

from pyspark.sql import functions as F

from themeloom.operators import centroids
from themeloom.streaming import feeds


def source(spark, tmp_path):
    rows = spark.sql(
        "select * from values ('a', 'Same text again and again', timestamp'2024-01-01 01:00:00', array(1f, 0f)),"
        " ('a', 'same text again AND again', timestamp'2024-01-01 02:00:00', array(0f, 1f)),"
        " ('b', 'another long enough text', timestamp'2024-01-01 03:00:00', array(0.98f, 0.199f)),"
        " ('b', 'short', timestamp'2024-01-05 00:00:00', array(0.707f, 0.707f))"
        " t(source, text, timestamp, embedding)")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drain(spark, stream, tmp_path, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_clean_and_dedupe(spark, tmp_path):
    rows = drain(spark, feeds.first_copies(feeds.clean(source(spark, tmp_path))), tmp_path, "firsts")
    assert len(rows) == 2 and {r.source for r in rows} == {"a", "b"}


def test_daily_mentions(spark, tmp_path):
    rows = drain(spark, feeds.daily_mentions(source(spark, tmp_path)), tmp_path, "daily")
    assert {(r.source, r.mentions) for r in rows} == {("a", 2), ("b", 1)}


def test_assignment(spark, tmp_path):
    known = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1)], "seq long, embedding array<double>, cluster_id int")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    writer = feeds.assign_to_themes(source(spark, tmp_path), centroids.centroids(known), out, cp, 0.9)
    writer.trigger(availableNow=True).start().awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("timestamp").collect()
    assert [r.cluster_id for r in rows] == [0, 1, 0, -1]


def test_mentions_filter(spark, tmp_path):
    stream = source(spark, tmp_path).withColumn("inbound", F.lit("True"))
    assert len(drain(spark, feeds.mentions(stream, "AGAIN"), tmp_path, "mentions")) == 2


def arrived(spark, tmp_path, files, name, buckets):
    """Rows that ``earliest_copies`` sends when each of ``files`` is a micro-batch, and the
    groups in its state at the end."""
    schema = "text_clean string, timestamp timestamp, seq long"
    path = str(tmp_path / f"in-{name}")
    for k, rows in enumerate(files):
        frame = spark.createDataFrame(rows, "text_clean string, day double, seq long")
        frame = frame.selectExpr("text_clean", "timestamp_seconds(day * 86400) AS timestamp", "seq")
        frame.coalesce(1).write.mode("append").parquet(path)
        for file in (tmp_path / f"in-{name}").glob("*.parquet"):
            if f"at{k}" not in file.name and not file.name.startswith("at"):
                file.rename(file.with_name(f"at{k}-{file.name}"))
                os.utime(file.with_name(f"at{k}-{file.name}"), (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / f"out-{name}")
    writer = feeds.write_batches(feeds.earliest_copies(stream, 7, buckets), out, str(tmp_path / f"cp-{name}"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    sent = spark.read.option("basePath", out).parquet(out).orderBy("batch", "seq").collect()
    days = [(r.batch, None if r.micros == feeds.NO_TIME else r.micros / 86400e6, r.seq) for r in sent]
    return days, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_texts_share_groups(spark, tmp_path):
    first = [(f"text {i}", 3.0, i) for i in range(40)] + [(f"TEXT {i}", 2.0, 100 + i) for i in range(5)]
    second = [(f"text {i}", 1.0 if i < 9 else 4.0, 200 + i) for i in range(20)] + [("new", None, 300), ("new", None, None)]
    sent, groups = arrived(spark, tmp_path, [first, second], "share", 4)
    want = [(0, 3.0, i) for i in range(5, 40)] + [(0, 2.0, 100 + i) for i in range(5)]
    want += [(1, 1.0, 200 + i) for i in range(9)] + [(1, None, 300)]
    assert sent == want and groups <= 4


def test_texts_leave_the_state_after_the_horizon(spark, tmp_path):
    files = [[("a", 1.0, 1), ("b", 99.0, 2)], [("b", 98.0, 3)], [("a", 100.0, 4), ("a", 0.5, 5), ("b", 101.0, 6)]]
    for buckets in (1, 64):
        sent, _ = arrived(spark, tmp_path, files, f"leave{buckets}", buckets)
        assert sent == [(0, 1.0, 1), (0, 99.0, 2), (1, 98.0, 3), (2, 100.0, 4)]

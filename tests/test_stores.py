"""Dataset store, keyed store and counters gathered while writing."""

import pytest
from pyspark.sql import functions as F

from themeloom.operators import embed
from themeloom.runtime import stage_counting
from themeloom.sources import keyed, readers, sinks, store


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, n int")


def test_datasets_are_replaced_as_a_whole(spark, tmp_path):
    held = store.DatasetStore(spark, str(tmp_path / "store"))
    assert held.datasets().count() == 0
    with pytest.raises(KeyError):
        held.read()
    held.write(people(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4)), F.col("name"))
    before = held.read("a")
    held.write(people(spark, ("a", 9)), F.col("name"))
    assert [(r.dataset, r.n_rows, r.version) for r in held.datasets().collect()] == [("a", 1, 2), ("b", 1, 1)]
    assert [(r.dataset, r.n) for r in held.read().orderBy("n").collect()] == [("b", 3), ("a", 9)]
    # Who has opened the older version can still read it.
    assert sorted(r.n for r in before.collect()) == [1, 2]
    with pytest.raises(KeyError):
        held.read("a", "c")
    held.drop(["b"])
    assert [r.dataset for r in held.datasets().collect()] == ["a"]
    held.write(people(spark).limit(0), F.col("name"))
    assert held.read().count() == 1


def test_a_failed_write_changes_nothing(spark, tmp_path):
    held = store.DatasetStore(spark, str(tmp_path / "store"))
    held.write(people(spark, ("a", 1)), F.col("name"))
    with pytest.raises(Exception, match="lost"):
        held.write(people(spark, ("a", 2)).withColumn("n", F.raise_error(F.lit("lost"))), F.col("name"))
    assert [(r.dataset, r.n) for r in held.read().collect()] == [("a", 1)]


def test_two_writers_both_get_through(spark, tmp_path, monkeypatch):
    held = store.DatasetStore(spark, str(tmp_path / "store"))
    held.write(people(spark, ("a", 1)), F.col("name"))
    stale = [1, None]
    actual = store.DatasetStore._version

    def version(self):
        if stale[0] == 1 and stale[1] is None:
            stale[1] = True
            held_now = actual(self)
            store.DatasetStore(spark, held.root).write(people(spark, ("b", 2)), F.col("name"))
            return held_now
        return actual(self)

    monkeypatch.setattr(store.DatasetStore, "_version", version)
    held.write(people(spark, ("c", 3)), F.col("name"))
    assert sorted((r.dataset, r.n) for r in held.read().collect()) == [("a", 1), ("b", 2), ("c", 3)]


def exchanges_above(plan: str, table: str) -> int:
    """Exchanges between the scan of a table and the join above it."""
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan" in line and table in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), 0
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if own < depth:
            depth = own
            if "Join" in line:
                return found
            found += "Exchange" in line
    return found


def test_keyed_store_is_not_shuffled_and_second_run_encodes_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = keyed.KeyedStore.create(spark, str(tmp_path / "vectors"), "vector_key string, embedding array<float>", "vector_key")
        texts = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "seq long, text_clean string")
        asked = []

        def encoder(todo):
            rows = todo.cache()
            asked.append(rows.count())
            return rows.withColumn("embedding", F.array(F.length("text_clean").cast("float")))

        for part in (texts.filter("seq < 30"), texts, texts):
            out, _ = embed.embed_with_store(part, held, encoder, "m")
            assert out.filter("embedding IS NULL").count() == 0 and out.count() == part.count()
        assert asked == [30, 10, 0]
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert exchanges_above(plan.split("== Initial Plan ==")[0], "keyed_") == 0
        old = held.version
        held.compact()
        assert held.version != old and held.rows().count() == 40
        again = keyed.KeyedStore.open(spark, str(tmp_path / "vectors"), held.schema, held.key, held.buckets, held.version)
        assert again.rows().count() == 40
        files = [f for f in held.rows().inputFiles()]
        assert len(files) <= held.buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counters_are_those_of_the_written_rows(spark):
    df = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1).repartition(5)
    written, seen = stage_counting(df, "numbers", n=F.count(F.lit(1)), odd=F.count_if("odd"), most=F.max("id"))
    assert seen == {"n": 1000, "odd": 500, "most": 999} and written.count() == 1000
    _, none = stage_counting(df.limit(0), "none", n=F.count(F.lit(1)))
    assert none == {"n": 0}


def test_broken_lines_are_rows_of_their_own(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([(1, [("x", 2)])], "id long, parts array<struct<name:string,n:int>>")
    sinks.write_insights(rows, path)
    spark.createDataFrame([('{"id": 2, "parts": [{"na',), ("",), ("no record",)], "value string").write.mode("append").text(path)
    back = readers.read_records(spark, path, rows.schema)
    got = sorted((r.id, r._broken) for r in back.collect() if r.id is not None)
    assert got == [(1, None)]
    assert back.filter("_broken IS NOT NULL AND id IS NULL").count() == 2


def test_largest_export_counts_all_its_files(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:05d}", "big" if i % 3 else "small") for i in range(300)], "line string, source string")
    sinks.write_by(df.repartition(6), "source", str(tmp_path / "out"))
    sizes = readers.folder_sizes(spark, str(tmp_path / "out")).collect()
    assert [(r.folder.rsplit("=", 1)[1], r.n_bytes) for r in sizes] == [("big", 1200), ("small", 600)]
    assert sizes[0].n_files > 1

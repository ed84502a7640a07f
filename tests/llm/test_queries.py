"""Registered queries and the pipeline on the smallest tables."""

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from themeloom.llm.inputs import table
from themeloom.llm.queries import QUERIES

ROWS = {"op7_quotation_linking": "conversations", "op10_html_extraction": "pages", "op13_whitening": "embeddings"}


def test_registry():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_a_row_for_each_input(spark, tiny, name):
    each = 4 if name == "op13_whitening" else 1
    assert QUERIES[name](spark, tiny).count() == each * table(spark, tiny, ROWS.get(name, "documents")).count()


def test_pipeline(spark, tiny):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "packing"
    ]
    docs = table(spark, tiny, "documents")
    rows = docs.unionByName(docs.limit(5)).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0)], docs.schema)
    )
    for _, work in corpus_pipeline.STAGES[:-1]:
        kept = work(spark, rows, tiny)
        assert kept.schema == docs.schema
        assert kept.count() <= rows.count() and kept.exceptAll(rows).count() == 0
        rows = spark.createDataFrame(kept.collect(), docs.schema)
    assert rows.count() == rows.select("doc_id").distinct().count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, tiny).count() == rows.count()
    assert corpus_pipeline.run(spark, tiny).count() > 0

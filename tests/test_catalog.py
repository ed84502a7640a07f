"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(rows, order):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= len(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = comparable(df.collect(), [df.columns.index(c) for c in sorted(names)])
    want = comparable(cursor.fetchall(), [names.index(c) for c in sorted(names)])
    assert got == want


@pytest.mark.parametrize("name", ["lang_score", "embed_tfidf", "annotate_themes"])
def test_query_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0

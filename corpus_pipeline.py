"""From ``documents`` to packed batches: quality, exact copies, near copies, mixture, packing.

Every stage works on all rows that the stage before it kept; its decisions take
effect, and its rows are written as Parquet and read again before the next one.
Stages but the last return the columns of ``documents``. Nulls, empty and long texts,
ties, repeated rows and empty tables are handled as the operator of each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import exact, jaccard, mixing, packing, quality
from themeloom.llm.inputs import table
from themeloom.runtime import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays: words in five-word
    shingles, similarity of 0.8 or more."""
    return jaccard.keep_one(docs, jaccard.JaccardSettings(words=5, percent=80))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities stay."""
    return mixing.keep_sample(docs)


def packed_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets, batches and places of the documents."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing to target weights", mixing_weights),
    ("packing", packed_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: No SQL: the stages hash n-grams, build indexes and draw by hash.
ORACLE_SQL = None

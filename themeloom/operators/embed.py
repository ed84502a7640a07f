"""Texts to unit vectors, and their reuse by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.runtime import stage
from themeloom.sources.keyed import KeyedStore


def tfidf(df: DataFrame, text_col: str = "text_clean", n_features: int = 1024) -> DataFrame:
    """Adds ``embedding``: unit TF-IDF vector over hashed words (ARRAY<FLOAT>).

    The fitted model is one vector of ``n_features`` weights.
    """
    pipeline = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=n_features),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    )
    model = pipeline.fit(df.select(text_col))
    return (
        model.transform(df)
        .withColumn("embedding", vector_to_array("_unit", "float32"))
        .drop("_words", "_tf", "_tfidf", "_unit")
    )


def term_weights(df: DataFrame, text_col: str = "text_clean") -> DataFrame:
    """(seq, term, weight): unit TF-IDF weights of real words, without hashing.

    Texts are dealt by row, so words are counted where they are taken. The rarities are
    written, so that Spark knows whether they are small enough to broadcast. A word that is in every row has weight 0; rows made of such words only have no direction and
    keep zero weights.
    """
    words = F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = df.select("seq", text_col).repartition("seq").select("seq", F.explode(words).alias("term")).groupBy("seq", "term").agg(F.count("*").alias("n"))
    counts = stage(counts, "term-counts")
    n_rows = df.agg(F.count("*").alias("n")).scalar()
    rarity = stage(counts.groupBy("term").agg(F.log((n_rows + 1.0) / (F.count("*") + 1.0)).alias("idf")), "rarity")
    weighed = counts.join(rarity, "term").select("seq", "term", (F.col("n") * F.col("idf")).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("seq")))
    return weighed.select("seq", "term", F.coalesce(F.col("x") / F.nullif(length, F.lit(0.0)), F.lit(0.0)).alias("weight"))


def encode(
    df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = "text_clean", batch_size: int = 64,
) -> DataFrame:
    """Adds ``embedding`` with any batch encoder. ``load`` runs once per Python
    task and returns a function from texts to vectors; they are normalised here."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            parts = [
                np.asarray(encoder(texts[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(texts), batch_size)
            ]
            vectors = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list(vectors / np.maximum(lengths, 1e-12)))

    return df.withColumn("embedding", run(F.col(text_col)))


def vector_key(model: str, text: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\u001f", F.lit(model), text), "UTF-8"), 256)


def split_by_reuse(df: DataFrame, store: DataFrame, model: str, text_col: str = "text_clean") -> tuple[DataFrame, DataFrame]:
    """(known vectors per key, texts still to encode), one row per distinct text.

    ``store`` is (vector_key, embedding). Copies collapse before the joins, so
    both sides are unique on the key and no key can be hot.
    """
    texts = df.groupBy(vector_key(model, F.col(text_col)).alias("vector_key")).agg(
        F.min(text_col).alias(text_col)
    )
    stored = store.select("vector_key", "embedding")
    hits = texts.select("vector_key").join(stored, "vector_key")
    return hits, texts.join(stored, "vector_key", "left_anti")


def embed_with_reuse(
    df: DataFrame, store: DataFrame, encoder: Callable[[DataFrame], DataFrame], model: str, text_col: str = "text_clean"
) -> tuple[DataFrame, DataFrame]:
    """(corpus with vectors, new (vector_key, embedding) rows for the store)."""
    hits, todo = split_by_reuse(df, store, model, text_col)
    fresh = stage(encoder(todo).select("vector_key", "embedding"), "vectors")
    vectors = hits.select("vector_key", "embedding").unionByName(fresh)
    keyed = df.drop("embedding").withColumn("vector_key", vector_key(model, F.col(text_col)))
    return keyed.join(vectors, "vector_key", "left"), fresh


def embed_with_store(
    df: DataFrame, store: KeyedStore, encoder: Callable[[DataFrame], DataFrame], model: str, text_col: str = "text_clean"
) -> tuple[DataFrame, DataFrame]:
    """``embed_with_reuse`` on a bucketed store, to which the new vectors are added.

    Texts are dealt into the buckets of the store; the store itself is not moved.
    """
    texts = store.dealt(df.select(vector_key(model, F.col(text_col)).alias("vector_key"), text_col))
    texts = texts.groupBy("vector_key").agg(F.min(text_col).alias(text_col))
    todo = texts.join(store.rows().select("vector_key"), "vector_key", "left_anti")
    fresh = stage(encoder(todo).select("vector_key", "embedding"), "vectors")
    store.append(fresh)
    keyed = store.dealt(df.drop("embedding").withColumn("vector_key", vector_key(model, F.col(text_col))))
    return keyed.join(store.rows(), "vector_key", "left"), fresh


def missing_vectors(df: DataFrame) -> DataFrame:
    """Items without a usable vector; non-empty means the inputs do not match."""
    return df.filter(F.col("embedding").isNull() | (F.size("embedding") == 0)).select("id")

"""Centroids, cohesion, member order and soft assignment of noise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.vectors import dot, norm, unit
from themeloom.operators.ranking import spread_row_number
from themeloom.runtime import stage
from themeloom.schema import NOISE

CHUNK_BYTES = 64 << 20


def cluster_sums(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster_id, n, total, squares): combinable sums, noise excluded."""
    members = df.filter((F.col("cluster_id") != NOISE) & F.col(vector).isNotNull())
    vec = array_to_vector(F.col(vector).cast("array<double>"))
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.sum(vec)).alias("total"),
        F.sum(dot(F.col(vector), F.col(vector))).alias("squares"),
    )


def centroids(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(cluster_id, n, centroid): unit-length mean vector."""
    mean = F.transform("total", lambda x: x / F.col("n"))
    return cluster_sums(df, vector).select("cluster_id", "n", unit(mean).alias("centroid"))


def cohesion(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine per cluster, linear in members:
    (|sum|^2 - sum |v|^2) / (n (n - 1)); a single member counts as 1."""
    n = F.col("n").cast("double")
    pairs = (F.pow(norm(F.col("total")), 2) - F.col("squares")) / (n * (n - 1))
    return cluster_sums(df, vector).select(
        "cluster_id", F.when(F.col("n") > 1, pairs).otherwise(1.0).alias("cohesion")
    )


def add_centroid_cosine(df: DataFrame, cents: DataFrame, vector: str = "embedding") -> DataFrame:
    """Cosine of every clustered member to its own centroid. ``cents`` is small
    per dimension but grows with clusters, so it is written and Spark decides by
    its size; a shuffled join splits hot clusters adaptively."""
    table = stage(cents.select("cluster_id", "centroid"), "centroids")
    return (
        df.join(table, "cluster_id", "left")
        .withColumn("centroid_cos", dot(F.col(vector), F.col("centroid")))
        .drop("centroid")
    )


def centroid_rank(df: DataFrame, per_cluster: int | None = None) -> DataFrame:
    """Members nearest to their centroid first (``centroid_cos`` given).

    With ``per_cluster`` only the head is ranked, cut before the shuffle. The
    full order range-partitions by (cluster, cosine, seq), writes the slices and
    adds per-slice offsets, so no task ever holds a whole cluster.
    """
    members = df.filter((F.col("cluster_id") != NOISE) & F.col("centroid_cos").isNotNull())
    order = [F.desc("centroid_cos"), F.asc("seq")]
    if per_cluster is not None:
        window = Window.partitionBy("cluster_id").orderBy(*order)
        return members.withColumn("centroid_rank", F.row_number().over(window)).filter(
            F.col("centroid_rank") <= per_cluster
        )
    return spread_row_number(members, ["cluster_id"], order, "centroid_rank")


def _chunks(table: DataFrame, key: str, vector: str, dim_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A staged (key, vector) table as matrices of bounded size, in key order."""
    head = table.select(F.size(vector).alias("d")).head()
    if head is None:
        return
    rows = max(1, (dim_bytes or CHUNK_BYTES) // (8 * head["d"]))
    total = table.count()
    n_parts = -(-total // rows)
    bucket = F.pmod(F.xxhash64(key), F.lit(n_parts))
    parts = [table] if n_parts <= 1 else [table.filter(bucket == i) for i in range(n_parts)]
    for part in parts:
        pdf = part.select(key, vector).orderBy(key).toPandas()
        if len(pdf):
            yield pdf[key].to_numpy(), np.stack(pdf[vector].to_numpy()).astype(np.float64)


def _best_of(ids: np.ndarray, matrix: np.ndarray):
    """Running arg-max of the cosine over one piece of the centroid table."""

    @F.pandas_udf("best_id int, best_cos double")
    def best(vectors: pd.Series, known_id: pd.Series, known_cos: pd.Series) -> pd.DataFrame:
        keep = vectors.notna().to_numpy()
        new_id = known_id.astype("float64").to_numpy(copy=True)
        new_cos = known_cos.astype("float64").to_numpy(copy=True)
        if keep.any():
            cos = np.stack(vectors[keep].to_numpy()).astype(np.float64) @ matrix.T
            # Equal up to the last bits counts as a tie: the lowest id wins.
            pick = (cos >= cos.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
            top = cos[np.arange(len(pick)), pick]
            rows = np.flatnonzero(keep)
            better = np.isnan(new_cos[rows]) | (top > new_cos[rows] + 1e-12)
            better |= (np.abs(top - new_cos[rows]) <= 1e-12) & (ids[pick] < new_id[rows])
            new_id[rows[better]] = ids[pick[better]]
            new_cos[rows[better]] = top[better]
        return pd.DataFrame({"best_id": pd.array(new_id, dtype="Float64").astype("Int32"), "best_cos": new_cos})

    return best


def nearest_centroid(df: DataFrame, cents: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``best_id`` and ``best_cos``: exact cosine arg-max, lowest id on ties.

    The centroid table goes to the tasks in pieces of at most CHUNK_BYTES: one
    pass normally, further passes that keep the running best when it is larger.
    """
    table = stage(cents.select("cluster_id", "centroid"), "centroids")
    out = df.withColumn("best_id", F.lit(None).cast("int")).withColumn("best_cos", F.lit(None).cast("double"))
    for ids, matrix in _chunks(table, "cluster_id", "centroid"):
        best = _best_of(ids, matrix)
        out = out.withColumn("_b", best(vector, "best_id", "best_cos")).withColumn(
            "best_id", F.col("_b.best_id")
        ).withColumn("best_cos", F.when(~F.isnan("_b.best_cos"), F.col("_b.best_cos"))).drop("_b")
    return out


def soft_assign(df: DataFrame, min_cosine: float = 0.55, vector: str = "embedding") -> DataFrame:
    """Noise joins its nearest centroid at ``min_cosine`` or more and is marked
    ``from_noise``; members keep their cluster; without clusters nothing changes."""
    noise = df.filter(F.col("cluster_id") == NOISE)
    found = nearest_centroid(noise, centroids(df, vector), vector)
    accept = F.coalesce(F.col("best_cos") >= min_cosine, F.lit(False))
    moved = (
        found.withColumn("from_noise", accept)
        .withColumn("cluster_id", F.when(accept, F.col("best_id")).otherwise(F.col("cluster_id")))
        .drop("best_id", "best_cos")
    )
    settled = df.filter(F.col("cluster_id") != NOISE).withColumn("from_noise", F.lit(False))
    return settled.unionByName(moved.select(*settled.columns))

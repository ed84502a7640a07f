"""Whitening of embeddings by distributed block matrices.

Entries become whole numbers, ``floor(256 * c)``, so equal vectors are equal exactly.
The distinct vectors, each once, are numbered, centred and dealt into blocks of an MLlib
``BlockMatrix``; its transpose times itself is the scatter, whose middle dimension is
split over tasks and whose result has the size of one vector squared. The eigenvectors
of that small matrix come from ``numpy`` on the driver, and a second block product with
the whitening matrix projects all rows. Numbers of rows, vectors and blocks never reach
the driver but for the block numbers (one pair of ints for ``block_rows`` vectors).

Results for odd rows: rows whose vector is null, or has null or non-finite entries, are
left out, as are rows whose vector has another length than most rows (of two lengths
that are as frequent the longer one counts) or no entry; null and repeated ids keep
their rows; equal rows are one vector of the fit; a deviation beyond a long is null;
components without variance (eigenvalue below 1e-12 of the first) have no rows, so a
table of equal vectors and an empty table have an empty result; other columns play no
part. Of equal eigenvalues the order is that of ``numpy``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.operators.ranking import spread_row_number
from themeloom.runtime import stage

SCALE = 256
COMPONENTS = 4
#: Vectors of a block; entries of a vector in a block.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: Splits of the middle dimension of a scatter, for each core.
SPLITS = 4
FLAT = 1e-12
#: The largest difference whose square is a long.
ROOT = 3037000499
LONGEST = (1 << 63) - 1


@dataclass
class Fit:
    """Mean, eigenvalues (falling) and eigenvectors (columns) of n distinct vectors."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """The whitening matrix: eigenvectors over the roots of their eigenvalues."""
        return self.vectors / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` that take part, with ``x``, the whole numbers of their vectors; written once."""
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound)
    made = stage(usable.withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE).cast("long"))), "whole-vectors")
    lengths = made.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d"))
    most = lengths.first()
    return made.filter(F.size("x") == (most.d if most else 0))


def block_matrix(rows: DataFrame, n: int, d: int, block_rows: int | None = None) -> BlockMatrix:
    """Blocks of (row, values): ``row`` counts from 0 to n - 1."""
    vectors = rows.select(F.col("row").alias("index"), array_to_vector("values").alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows or BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(centred: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. Every split adds up its own blocks, so no task
    reads all of them."""
    spark = centred._java_matrix_wrapper._sc
    splits = max(1, min(centred.numRowBlocks, SPLITS * spark.defaultParallelism))
    wrapped = [m._java_matrix_wrapper._java_model for m in (centred.transpose(), centred)]
    product = BlockMatrix(wrapped[0].multiply(wrapped[1], splits), BLOCK_COLUMNS, BLOCK_COLUMNS)
    return product.toLocalMatrix().toArray()


def project(centred: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> DataFrame:
    """(row, values): the rows of the matrix times a small one, by blocks; written once."""
    small = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "row long, values array<double>")
    product = centred.multiply(block_matrix(small, *matrix.shape, BLOCK_COLUMNS))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return stage(rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("values")), "projected")


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def numbered(rows: DataFrame) -> DataFrame:
    """(row, x): the distinct vectors, numbered from 0."""
    order = spread_row_number(rows.select("x").distinct(), [], [F.asc("x")], "row", "long")
    return stage(order.withColumn("row", F.col("row") - 1), "distinct-vectors")


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    sums = (
        vectors.select(F.posexplode("x").alias("dim", "v")).groupBy("dim")
        .agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n")).orderBy("dim").collect()
    )
    return (sums[0].n if sums else 0), [int(r.s) for r in sums]


def centred(vectors: DataFrame, means: list[float], values: str) -> DataFrame:
    wide = F.zip_with(F.col(values).cast("array<double>"), _literals(means, "double"), lambda v, m: v - m)
    return vectors.select("row", wide.alias("values"))


def deviation(n: int, sums: list[int]) -> Column:
    """Exact sum over dimensions of (n * x - S)^2; null beyond a long."""
    whole = _literals([Decimal(s) for s in sums], "decimal(38,0)")
    apart = F.zip_with("x", whole, lambda v, s: v.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s)
    far = F.exists(apart, lambda v: F.abs(v) > ROOT)
    square = lambda v: (v.cast("long") * v.cast("long")).cast("decimal(38,0)")
    total = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda t, v: (t + square(v)).cast("decimal(38,0)"))
    exact = F.when(~far, total)
    return F.when(exact <= F.lit(Decimal(LONGEST)), exact).cast("long")


def fit(vectors: DataFrame, n: int, sums: list[int], components: int) -> tuple[Fit, BlockMatrix]:
    """Components of the numbered vectors, and their centred blocks."""
    d = len(sums)
    blocks = block_matrix(centred(vectors, [s / n for s in sums], "x"), n, d)
    covariance = scatter(blocks) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, int((values > max(values[0], 0) * FLAT).sum()))
    return Fit(n, sums, float(np.trace(covariance)), values[:count], axes[:, :count]), blocks


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest entry by which the covariance of the whitened vectors misses the identity."""
    means = projected.agg(*[F.avg(F.col("values")[i]) for i in range(k)]).first()
    covariance = scatter(block_matrix(centred(projected, list(means), "values"), n, k)) / n
    return float(np.abs(covariance - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each of its first whitened components."""
    spark = rows.sparkSession
    made = whole_vectors(rows.select("vec_id", vector), vector)
    vectors = numbered(made)
    n, sums = totals(vectors)
    known, blocks = fit(vectors, n, sums, components) if n > 1 else (None, None)
    if known is None or not len(known.values):
        return spark.createDataFrame([], RESULT)
    projected = project(blocks, known.matrix, spark)
    error = identity_error(projected, n, len(known.values))
    shares = _literals([float(v) / known.trace for v in known.values], "double")
    each = vectors.withColumn("deviation", deviation(n, sums)).join(projected, "row").select("x", "deviation", "values")
    wide = made.select(F.col("vec_id").cast("long"), "x").join(each, "x")
    return wide.select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )

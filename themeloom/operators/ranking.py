"""Exact row numbers without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.runtime import stage


def spread_row_number(df: DataFrame, groups: list[str], order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """row_number over (groups, order) for a total order, as ``kind`` (a group of more than
    two billion rows needs ``long``).

    Rows are range-partitioned by (groups, order), the slices are written once
    (so slice numbers cannot change when a task is retried), numbered inside
    each slice, and shifted by the size of the slices before them.
    """
    keys = [F.col(g) for g in groups]
    sliced = stage(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    ahead = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        sliced.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
        .select(*groups, "_slice", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead")),
        "slice-offsets",
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*groups, "_slice"])
        .withColumn(name, (F.col("_r") + F.col("_ahead")).cast(kind))
        .drop("_r", "_ahead", "_slice")
    )


def spread_max_before(df: DataFrame, groups: list[str], order: str, value: str, name: str) -> DataFrame:
    """Largest ``value`` of the rows of a group that come strictly before by ``order``, a
    whole number, without putting a whole group into one task.

    Rows of equal order fall into one slice of a range partitioning; each slice looks
    back inside itself and takes over the largest value of the slices before it.
    """
    sliced = stage(
        df.repartitionByRange(*[F.col(g) for g in groups], F.col(order)).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    ahead = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(
        sliced.groupBy(*groups, "_slice").agg(F.max(value).alias("_peak"))
        .select(*groups, "_slice", F.max("_peak").over(ahead).alias("_carried")),
        "slice-peaks",
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    found = F.greatest(F.max(value).over(inside), F.col("_carried"))
    return sliced.join(carried, [*groups, "_slice"]).withColumn(name, found).drop("_slice", "_carried")

"""Seeded samples whose rows do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def fixed_sample(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows, or all of them when there are no more than ``n``."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Up to ``n`` rows per group. The rank filter lets Spark keep only ``n``
    rows per group and map task before the shuffle, so a hot group stays small."""
    order = Window.partitionBy(group).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n)

"""Connected components of links, by stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.runtime import stage


def _pairs(links: DataFrame, centre: str, leaf: str) -> DataFrame:
    return links.select(F.col(centre).alias("a"), F.col(leaf).alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node reaches.

    ``links`` has columns ``a`` and ``b``. Each round hangs neighbours under the
    smallest node they know and is written, so lineage stays short. The number of
    rounds grows with the logarithm of the longest chain. Minima are combined on the
    map side; a node with very many links is one row for each task.
    """
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(large.filter("a <> b").distinct(), "large-star")
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b")))
        edges = stage(small.filter("a <> b").select("a", "b").distinct(), "small-star")
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())

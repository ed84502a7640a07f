"""Writers. Every sink is a distributed write; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, workspace: str) -> None:
    """One partition per workspace; writing a workspace again replaces it only."""
    (
        df.withColumn("workspace", F.lit(workspace))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("workspace").parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_insights(df: DataFrame, path: str) -> None:
    """Nested JSON, one insight per line."""
    df.write.mode("overwrite").json(path)


def write_by(df: DataFrame, column: str, path: str) -> None:
    """CSV files without a header, in a folder for each value of ``column``."""
    df.write.mode("overwrite").partitionBy(column).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat tables only, with a header and doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(blocks: DataFrame, path: str) -> None:
    """Markdown sections in rank order; the insight cap bounds their number."""
    blocks.orderBy("rank").select("block").coalesce(1).write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(path)


def list_workspaces(corpus: DataFrame) -> DataFrame:
    """Names of stored datasets (partition values of the corpus table)."""
    return corpus.select("workspace").distinct().orderBy("workspace")

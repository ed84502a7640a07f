"""Preparation of raw exports before ingest. Stateless steps also serve streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.sources.adapters import TIME_COLUMNS, first_present


def inbound_mentions(df: DataFrame, handle: str) -> DataFrame:
    """Inbound messages naming ``handle``; null text or flag is no match."""
    return df.filter(
        (F.lower(F.col("inbound").cast("string")) == "true")
        & F.contains(F.lower("text"), F.lit(handle.lower()))
    )


def conversation_starters(df: DataFrame, reply_col: str, minimum: int = 500) -> DataFrame:
    """Messages that reply to nothing, when at least ``minimum`` of them exist;
    otherwise every message. The count is a one-value scalar subquery."""
    found = df.agg(F.count_if(F.col(reply_col).isNull()).alias("n")).scalar()
    return df.filter(F.col(reply_col).isNull() | (found < minimum))


def most_recent(df: DataFrame, n: int, time_col: str | None = None, tie: str = "seq") -> DataFrame:
    """The ``n`` newest rows, unknown times last."""
    column = time_col or first_present(df.columns, TIME_COLUMNS)
    if column is None:
        return df.orderBy(tie).limit(n)
    return df.orderBy(F.col(column).desc_nulls_last(), tie).limit(n)

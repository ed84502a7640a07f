"""Cleaning with an explicit reason for every dropped row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import clean_text, text_hash


def add_clean_text(df: DataFrame) -> DataFrame:
    """Adds ``text_clean`` and its length. Once written, a filter on ``n_chars`` is
    pushed to the scan and the text itself is read only where it is used."""
    return df.withColumn("text_clean", clean_text(F.col("text"))).withColumn(
        "n_chars", F.length("text_clean")
    )


def keep_first(df: DataFrame, key: Column) -> DataFrame:
    """Rows with the smallest ``seq`` (a unique row number) of their key.

    Only (key, seq) goes through the aggregation, combined on the map side, so a
    hot key costs one row per task; wide rows are then matched on ``seq``, which
    is never hot.
    """
    firsts = df.groupBy(key.alias("_key")).agg(F.min("seq").alias("seq")).select("seq")
    return df.join(firsts, "seq", "left_semi").select(*df.columns)


def tag_drops(df: DataFrame, min_chars: int = 15, language: str | None = None) -> DataFrame:
    """Adds ``drop_reason``: too_short, wrong_language or null (kept).

    The language rule is active only for ``language='en'`` and needs a ``lang``
    column (see operators.language); an undecided language is dropped too.
    """
    length = F.col("n_chars") if "n_chars" in df.columns else F.length("text_clean")
    reason = F.when(length < min_chars, "too_short")
    if language == "en":
        reason = reason.when(~F.col("lang").eqNullSafe(language), "wrong_language")
    return df.withColumn("drop_reason", reason)


def drop_counters() -> dict[str, Column]:
    """Counts of tagged rows, as columns of an aggregate or an observation."""
    reason = F.col("drop_reason")
    return {
        "input": F.count(F.lit(1)),
        "dropped_too_short": F.count_if(reason == "too_short"),
        "dropped_wrong_language": F.count_if(reason == "wrong_language"),
        "output": F.count_if(reason.isNull()),
    }


def clean_stats(tagged: DataFrame) -> DataFrame:
    """One row: input, dropped_too_short, dropped_wrong_language, output."""
    return tagged.agg(*[c.alias(name) for name, c in drop_counters().items()])


def keep_clean(tagged: DataFrame) -> DataFrame:
    return tagged.filter("drop_reason IS NULL").drop("drop_reason")


def drop_exact_copies(df: DataFrame) -> DataFrame:
    """First row by ``seq`` of every distinct cleaned text."""
    return keep_first(df, text_hash(F.col("text_clean")))


def exact_copy_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct texts, copies. Counts go through one partial
    aggregate per text instead of a set per task."""
    return (
        df.groupBy(text_hash(F.col("text_clean")).alias("text_key"))
        .count()
        .agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_distinct"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_copies"),
        )
    )


def flag_copies(df: DataFrame) -> DataFrame:
    """``is_near_dup`` = an earlier row has the same cleaned text."""
    key = text_hash(F.col("text_clean"))
    firsts = df.groupBy(key.alias("_k")).agg(F.min("seq").alias("seq")).select("seq")
    return df.join(firsts.withColumn("_first", F.lit(True)), "seq", "left").withColumn(
        "is_near_dup", F.col("_first").isNull()
    ).drop("_first")


def fingerprint(df: DataFrame, model: str = "") -> DataFrame:
    """Order-free digest of a corpus: equal corpora give equal rows, and the
    partial results combine."""
    digest = F.md5(F.concat_ws("\u001f", F.lit(model), "id", "text_clean"))
    high = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 17, 8), 16, 10).cast("bigint")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.bit_xor(high).alias("xor_digest"),
        F.sum(low).alias("sum_digest"),
    )

"""Read-path queries over the persisted corpus and the insight table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.schema import NOISE

UNCLUSTERED = "Unclustered"
OTHER = "Other themes"

# Fixed display labels.
BADGE_LABELS = {
    "ok": "✅ Solid evidence",
    "low_sample": "⚠️ Low sample",
    "insufficient_evidence": "🚫 Insufficient evidence",
}
SOURCE_LABELS = {
    "play_store_review": "📱 Play Store review",
    "support_ticket": "🎫 Support ticket",
}
SEVERITY_MARKS = {1: "🟢", 2: "🟡", 3: "🟠", 4: "🔴", 5: "🔥"}


def _label(code: Column, labels: dict, default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for key, value in labels.items():
        out = out.when(code == key, value)
    return out.otherwise(default)


def badge_label(code: Column) -> Column:
    return _label(code, BADGE_LABELS, code)


def source_label(code: Column) -> Column:
    return _label(code, SOURCE_LABELS, code)


def severity_chip(severity: Column) -> Column:
    return F.concat(_label(severity, SEVERITY_MARKS, F.lit("⚪")), F.lit(" "), severity.cast("string"), F.lit("/5"))


def with_theme(df: DataFrame, themes: DataFrame) -> DataFrame:
    """Theme name per item. ``themes`` is the insight table (bounded by the
    analysed-cluster cap); its file size lets Spark choose the join."""
    names = themes.select("cluster_id", F.col("theme_name").alias("theme"))
    return df.join(names, "cluster_id", "left").withColumn(
        "theme", F.coalesce("theme", F.lit(UNCLUSTERED))
    )


def fold_themes(themed: DataFrame, keep: int = 12) -> DataFrame:
    """Largest ``keep`` themes and the unclustered bucket stay, others fold."""
    top = (
        themed.filter(F.col("theme") != UNCLUSTERED)
        .groupBy("theme").count()
        .orderBy(F.desc("count"), "theme").limit(keep)
        .select("theme", F.lit(True).alias("_top"))
    )
    view = F.when(F.col("_top") | (F.col("theme") == UNCLUSTERED), F.col("theme")).otherwise(OTHER)
    # ``top`` has at most ``keep`` rows by construction.
    return themed.join(F.broadcast(top), "theme", "left").withColumn("theme_view", view).drop("_top")


def map_points(folded: DataFrame) -> DataFrame:
    return folded.select(
        "id", "pca_x", "pca_y", "theme_view", "source", F.substring("text", 1, 110).alias("short_text")
    )


def search(
    themed: DataFrame, pattern: str | None = None, source: str | None = None, theme: str | None = None
) -> DataFrame:
    """Case-insensitive (in any script) regular expression, source and theme filters."""
    out = themed
    if pattern:
        out = out.filter(F.coalesce(F.col("text").rlike(f"(?iu){pattern}"), F.lit(False)))
    if source:
        out = out.filter(F.col("source") == source)
    if theme:
        out = out.filter(F.col("theme") == theme)
    return out.select("id", "text", "source", "theme", "rating", "sentiment", "timestamp")


def theme_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Corpus rows of a theme; members stay rows, never one collected list."""
    return df.join(members.select("id"), "id", "left_semi")


def monthly_mentions(df: DataFrame, fmt: str = "yyyy-MM") -> DataFrame:
    """Mentions per period; absent periods stay absent."""
    return (
        df.filter(F.col("timestamp").isNotNull())
        .groupBy(F.date_format("timestamp", fmt).alias("month"))
        .agg(F.count("*").alias("mentions"))
        .orderBy("month")
    )


def month_by_source(df: DataFrame, sources: list[str], fmt: str = "yyyy-MM") -> DataFrame:
    """Counts per period with one column per named source; naming the sources
    saves the extra pass that would discover them."""
    return (
        df.filter(F.col("timestamp").isNotNull())
        .groupBy(F.date_format("timestamp", fmt).alias("month"))
        .pivot("source", sources)
        .agg(F.count(F.lit(1)))
        .orderBy("month")
    )


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample deviation and interpolated quartiles per group.

    Rows are first counted per distinct value, so a hot group reaches the
    final task as one row per value (sentiment has four decimals: at most
    20,001 values).
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).count()
    n, v = F.col("count"), F.col("v")
    total = F.sum(n)
    mean = F.sum(v * n) / total
    # Values are in a small fixed range, so the sum-of-squares form is stable.
    variance = (F.sum(v * v * n) - F.sum(v * n) * F.sum(v * n) / total) / (total - 1)
    quartiles = [F.percentile("v", F.lit(p), n) for p in (0.25, 0.5, 0.75)]
    return counts.groupBy(group).agg(
        total.alias("count"),
        mean.alias("mean"),
        F.when(total > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.min("v").alias("min"),
        quartiles[0].alias("p25"),
        quartiles[1].alias("p50"),
        quartiles[2].alias("p75"),
        F.max("v").alias("max"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes; the maximum falls in the last bin.

    A single value gets a range of one around it, as plotting libraries do.
    """
    values = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    low = F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5)
    bounds = edges.select(F.struct(low.alias("lo"), spread.alias("w")).alias("b")).scalar()
    edge = F.col("b")
    bucket = F.least(
        F.lit(bins), F.floor((F.col("v") - edge["lo"]) * bins / edge["w"]).cast("int") + 1
    )
    # Count per distinct value first; the bin edges are then needed on few rows.
    return (
        values.groupBy("v").count()
        .withColumn("b", bounds)
        .groupBy(bucket.alias("bin"))
        .agg(F.sum("count").alias("n"))
        .orderBy("bin")
    )


def near_dup_share(df: DataFrame, top: int = 10) -> DataFrame:
    return (
        df.filter(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id")
        .agg(F.avg(F.col("is_near_dup").cast("double")).alias("near_dup_share"))
        .orderBy(F.desc("near_dup_share"), "cluster_id")
        .limit(top)
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("rating").isNotNull()).groupBy("rating")
        .agg(F.count("*").alias("n_items")).orderBy("rating")
    )


def filter_insights(
    insights: DataFrame, min_items: int = 1, only_ok: bool = False, sources: tuple[str, ...] = ()
) -> DataFrame:
    out = insights.filter(F.col("confidence.n_items") >= min_items)
    if only_ok:
        out = out.filter(F.col("confidence.badge") == "ok")
    for source in sources:
        out = out.filter(F.map_contains_key("per_source_counts", F.lit(source)))
    return out


def kpis(insights: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: corpus size, sources, themes, low-confidence and verified counts."""
    sizes = corpus.groupBy("source").count()
    n_items = sizes.agg(F.sum("count").alias("n")).scalar()
    n_sources = sizes.agg(F.count("*").alias("n")).scalar()
    return insights.agg(
        F.count("*").alias("n_themes"),
        F.count_if(F.col("confidence.badge") != "ok").alias("n_low_confidence"),
        F.count_if("citation_check_passed").alias("n_citations_ok"),
    ).select(n_items.alias("n_items"), n_sources.alias("n_sources"), "*")


def badge_histogram(insights: DataFrame) -> DataFrame:
    return insights.groupBy(F.col("confidence.badge").alias("badge")).agg(F.count("*").alias("n"))


def last_turns(turns: DataFrame, keep: int = 6, user: str = "PM", other: str = "Analyst") -> DataFrame:
    """Last ``keep`` turns of each conversation, rendered oldest first.

    The rank filter keeps at most ``keep`` turns per conversation and map task
    before the shuffle.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.when(F.col("role") == "user", user).otherwise(other), F.lit(": "), F.col("text"))
    recent = turns.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep)
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent.groupBy("conv_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history")
    )


def chat_prompt(history: DataFrame, question: str, user: str = "PM", other: str = "Analyst") -> DataFrame:
    return history.withColumn(
        "prompt",
        F.concat_ws("\n", F.nullif(F.col("history"), F.lit("")), F.lit(f"{user}: {question}"), F.lit(f"{other}:")),
    )

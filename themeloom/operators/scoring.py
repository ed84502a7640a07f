"""Per-cluster statistics, priority and confidence in one aggregation.

Everything is derived from per (cluster, source) partials, so one shuffle of
pre-aggregated rows feeds every score and a huge cluster costs no more than a
small one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import measures
from themeloom.operators.ranking import spread_row_number
from themeloom.runtime import stage
from themeloom.schema import NOISE


@dataclass(frozen=True)
class ScoreSettings:
    """Fixed default weights and limits."""

    w_frequency: float = 0.35
    w_severity: float = 0.35
    w_recency: float = 0.15
    w_diversity: float = 0.15
    mix_annotated: float = 0.5
    mix_rating: float = 0.3
    mix_sentiment: float = 0.2
    half_life_days: float = 90.0
    insufficient_below: int = 5
    low_sample_below: int = 15
    low_cohesion: float = 0.35
    confidence: float = 0.95
    negative_below: float = -0.05


def per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n_items")).orderBy(F.desc("n_items"), "source")


def add_source_age(df: DataFrame) -> DataFrame:
    """``age_days`` against the newest item of the same source.

    The per-source maxima are a written table whose real size decides between a
    broadcast and a shuffled join; a window over source would put one whole
    source into one task.
    """
    newest = stage(
        df.groupBy("source").agg(F.max("timestamp").alias("_newest")), "newest-per-source"
    )
    age = measures.days_between(F.col("_newest"), F.col("timestamp"))
    return df.join(newest, "source", "left").withColumn("age_days", age).drop("_newest")


def recency_at(df: DataFrame, now: Column, half_life_days: float = 90.0) -> DataFrame:
    """Recency per cluster against one given instant."""
    age = measures.days_between(now, F.col("timestamp"))
    return df.groupBy("cluster_id").agg(
        F.coalesce(F.avg(measures.decay(age, half_life_days)), F.lit(0.5)).alias("recency")
    )


def cluster_partials(df: DataFrame, settings: ScoreSettings = ScoreSettings()) -> DataFrame:
    """Per (cluster, source) sums that every later figure combines."""
    rating = F.col("rating")
    sentiment = F.coalesce(F.col("sentiment"), F.lit(0.0))
    return df.groupBy("cluster_id", "source").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("is_near_dup")).alias("n_unique"),
        F.count_if(sentiment < settings.negative_below).alias("n_negative"),
        F.count(rating).alias("n_rated"),
        F.sum((5 - rating) / 4).alias("gloom"),
        F.sum(F.abs(sentiment)).alias("mood"),
        F.count("age_days").alias("n_aged"),
        F.sum(measures.decay(F.col("age_days"), settings.half_life_days)).alias("freshness"),
    )


def cluster_stats(partials: DataFrame) -> DataFrame:
    """One row per cluster; the source map has one entry per source type."""
    n = F.col("n")
    return partials.groupBy("cluster_id").agg(
        F.sum("n").alias("n_items"),
        F.sum("n_unique").alias("n_unique"),
        F.sum("n_negative").alias("n_negative"),
        F.sum("n_rated").alias("n_rated"),
        F.sum("gloom").alias("gloom"),
        F.sum("mood").alias("mood"),
        F.sum("n_aged").alias("n_aged"),
        F.sum("freshness").alias("freshness"),
        F.sum(n * F.log(n.cast("double"))).alias("n_log_n"),
        F.count("*").alias("n_sources"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias(
            "per_source_counts"
        ),
    )


def cluster_summary(df: DataFrame, cohesion: DataFrame | None = None) -> DataFrame:
    """Size, unique size and source map of every cluster, noise included."""
    counts = df.groupBy("cluster_id", "source").agg(
        F.count("*").alias("n"), F.count_if(~F.col("is_near_dup")).alias("u")
    )
    out = counts.groupBy("cluster_id").agg(
        F.sum("n").alias("n_items"),
        F.sum("u").alias("n_unique"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"),
    )
    if cohesion is not None:
        out = out.join(cohesion.select("cluster_id", "cohesion"), "cluster_id", "left")
        out = out.withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))
    return out.orderBy(F.desc("n_items"), "cluster_id")


def top_clusters(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Clusters by size without the noise bucket: all, or the ``cap`` largest (how many
    of them an annotator is asked about)."""
    sizes = (
        df.filter(F.col("cluster_id") != NOISE)
        .groupBy("cluster_id")
        .agg(F.count("*").alias("n_items"))
        .orderBy(F.desc("n_items"), "cluster_id")
    )
    return sizes if cap is None else sizes.limit(cap)


def noise_stats(df: DataFrame) -> DataFrame:
    """Cluster count, noise share (after soft assignment) and soft-assigned count."""
    sizes = df.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_if("from_noise").alias("soft")
    )
    is_noise = F.col("cluster_id") == NOISE
    return sizes.agg(
        F.count_if(~is_noise).alias("n_clusters"),
        F.coalesce(
            F.round(F.sum(F.when(is_noise, F.col("n")).otherwise(0)) / F.sum("n"), 4), F.lit(0.0)
        ).alias("noise_share"),
        F.coalesce(F.sum("soft"), F.lit(0)).alias("soft_assigned_from_noise"),
    )


def add_components(
    stats: DataFrame, source_types: DataFrame, largest_size: DataFrame, settings: ScoreSettings
) -> DataFrame:
    """F, S, R and D of every cluster. ``stats`` carries an annotated ``severity``
    in 1..5; ``source_types`` holds the corpus-wide number of sources and
    ``largest_size`` the size of the largest cluster, annotated or not."""
    largest = largest_size.scalar()
    n_types = source_types.scalar()
    n = F.col("n_items").cast("double")
    mood = F.col("mood") / n
    annotated = (F.col("severity") - 1) / 4.0
    rating = F.col("gloom") / F.col("n_rated")
    severity = F.when(
        F.col("n_rated") == 0,
        settings.mix_annotated * annotated + (settings.mix_sentiment + settings.mix_rating) * mood,
    ).otherwise(
        settings.mix_annotated * annotated
        + settings.mix_rating * rating
        + settings.mix_sentiment * mood
    )
    entropy = F.log(n) - F.col("n_log_n") / n
    return (
        stats.withColumn("n_largest", largest)
        .withColumn("n_source_types", n_types)
        .withColumn("mood_mean", mood)
        .withColumn("rating_gloom", F.when(F.col("n_rated") > 0, rating).otherwise(0.0))
        .withColumn("f_norm", measures.frequency(F.col("n_items"), F.col("n_largest")))
        .withColumn("s_norm", severity)
        .withColumn(
            "r_norm",
            F.when(F.col("n_aged") > 0, F.col("freshness") / F.col("n_aged")).otherwise(0.5),
        )
        .withColumn(
            "d_norm",
            F.when(F.col("n_source_types") > 1, entropy / F.log(F.col("n_source_types").cast("double")))
            .otherwise(0.0),
        )
    )


def _component(name: str, raw: Column, norm: Column, weight: float, why: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        raw.cast("double").alias("raw_value"),
        F.round(norm, 4).alias("normalized"),
        F.lit(weight).alias("weight"),
        F.round(weight * norm, 4).alias("contribution"),
        why.alias("explanation"),
    )


def score_clusters(
    df: DataFrame,
    severity: DataFrame,
    cohesion: DataFrame,
    settings: ScoreSettings = ScoreSettings(),
) -> DataFrame:
    """Priority, component records and confidence of every annotated cluster.

    ``severity``: (cluster_id, severity); ``cohesion``: (cluster_id, cohesion).
    Each contribution is rounded before the sum, and the sum again.
    """
    partials = stage(cluster_partials(df, settings), "cluster-partials")
    # One row per (cluster, source): distinct sources come from it, noise included.
    n_types = partials.agg(F.count_distinct("source").alias("k"))
    clusters = cluster_stats(partials).filter(F.col("cluster_id") != NOISE)
    largest = clusters.agg(F.max("n_items").alias("n"))
    stats = (
        clusters.join(severity.select("cluster_id", "severity"), "cluster_id")
        .join(cohesion.select("cluster_id", "cohesion"), "cluster_id", "left")
        .withColumn("cohesion", F.coalesce("cohesion", F.lit(0.0)))
    )
    return with_priority(add_components(stats, n_types, largest, settings), settings)


def with_priority(scored: DataFrame, settings: ScoreSettings = ScoreSettings()) -> DataFrame:
    s = settings
    components = F.array(
        _component(
            "frequency", F.col("n_items"), F.col("f_norm"), s.w_frequency,
            F.format_string("%d items on a log scale against the largest cluster (%d)",
                            F.col("n_items"), F.col("n_largest")),
        ),
        _component(
            "severity", F.col("severity"), F.col("s_norm"), s.w_severity,
            F.format_string(
                f"annotated severity %d/5 (w={s.mix_annotated}), inverse rating %.2f "
                f"(w={s.mix_rating}), mean |sentiment| %.2f (w={s.mix_sentiment})",
                F.col("severity"), F.col("rating_gloom"), F.col("mood_mean"),
            ),
        ),
        _component(
            "recency", F.round("r_norm", 4), F.col("r_norm"), s.w_recency,
            F.lit(f"half-life {s.half_life_days:.0f} days, age against the newest item of the source"),
        ),
        _component(
            "source_diversity", F.col("n_sources"), F.col("d_norm"), s.w_diversity,
            F.concat(F.lit("normalised entropy over "), F.to_json("per_source_counts")),
        ),
    )
    total = F.aggregate("score_components", F.lit(0.0), lambda acc, c: acc + c["contribution"])
    low, high = measures.wilson_bounds(F.col("n_negative"), F.col("n_items"), s.confidence)
    confidence = F.struct(
        F.col("n_items"),
        F.col("n_unique"),
        measures.badge(F.col("n_items"), s.insufficient_below, s.low_sample_below).alias("badge"),
        F.round(low, 4).alias("wilson_low"),
        F.round(high, 4).alias("wilson_high"),
        F.round(F.col("n_negative") / F.col("n_items"), 4).alias("negative_share"),
        F.round("cohesion", 4).alias("cohesion"),
        (F.col("cohesion") < s.low_cohesion).alias("mixed_theme_warning"),
    )
    return (
        scored.withColumn("score_components", components)
        .withColumn("priority_score", F.round(total, 4))
        .withColumn("confidence", confidence)
    )


def rank_themes(insights: DataFrame) -> DataFrame:
    """Ranks from 1 by priority, over two narrow columns in slices; ``insights`` is a
    written table, for it is read twice."""
    narrow = insights.select("cluster_id", "priority_score")
    ranked = spread_row_number(narrow, [], [F.desc("priority_score"), F.asc("cluster_id")], "rank")
    return insights.join(ranked.select("cluster_id", "rank"), "cluster_id").select(*insights.columns, "rank")

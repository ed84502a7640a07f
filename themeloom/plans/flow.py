"""End to end: unified rows to ranked insights, for any mix of sources."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import (
    annotate, centroids, cleaning, density, embed, language, neardup, projection, quotes, report,
    scoring, sentiment,
)
from themeloom.runtime import stage, stage_counting
from themeloom.schema import NOISE


@dataclass(frozen=True)
class FlowSettings:
    """Fixed defaults of a run."""

    min_text_chars: int = 15
    language: str | None = None
    near_dup_cosine: float = 0.92
    components: int = 15
    min_cluster_size: int = 8
    scale_cluster_size: bool = False
    min_samples: int = 1
    noise_reassign_cosine: float = 0.55
    max_clusters: int | None = None
    max_quotes: int = 15
    minimum_rows: int = 20
    score: scoring.ScoreSettings = field(default_factory=scoring.ScoreSettings)


def prepare(
    rows: DataFrame, lexicon: DataFrame, settings: FlowSettings = FlowSettings(),
    language_model: PipelineModel | None = None, embed_fn: Callable[[DataFrame], DataFrame] = embed.tfidf,
) -> tuple[DataFrame, DataFrame]:
    """(corpus, stats): clean, dedupe, vectors, near-duplicates, clusters, signals.

    Cheap filters run before vectors and clustering. Too few usable rows raise
    with the cleaning counts.
    """
    rows = cleaning.add_clean_text(rows)
    if settings.language == "en":
        if language_model is None:
            raise ValueError("language='en' needs a language model")
        long_enough = rows.filter(F.col("n_chars") >= settings.min_text_chars)
        short = rows.filter(F.col("n_chars") < settings.min_text_chars).withColumn("lang", F.lit(None).cast("string"))
        rows = language.add_language(long_enough, language_model).unionByName(short)
    tagged, counts = stage_counting(
        cleaning.tag_drops(rows, settings.min_text_chars, settings.language), "tagged", **cleaning.drop_counters()
    )
    if counts["output"] < settings.minimum_rows:
        raise ValueError(f"only {counts['output']} usable rows after cleaning: {counts}")
    stats = rows.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))
    unique = stage(cleaning.drop_exact_copies(cleaning.keep_clean(tagged)), "unique")
    # Vectors, flags, clusters and sentiment are narrow tables keyed by seq. The
    # texts move once, in the final join, whose sides share that key.
    texts = unique.select("seq", "text_clean")
    vectors = stage(embed_fn(texts).select("seq", "embedding"), "vectors")
    if embed_fn is embed.tfidf:
        flags = neardup.flag_text(texts, settings.near_dup_cosine)
    else:
        flags = neardup.flag_dense(vectors, settings.near_dup_cosine)
    size = settings.min_cluster_size
    if settings.scale_cluster_size:
        size = density.scaled_cluster_size(unique.count(), size)
    clustered = density.density_clusters(vectors, settings.components, size, settings.min_samples)
    placed = projection.map_coordinates(stage(clustered.drop("reduced"), "clustered"))
    assigned = stage(centroids.soft_assign(placed, settings.noise_reassign_cosine), "assigned")
    members = centroids.add_centroid_cosine(assigned, centroids.centroids(assigned))
    scores = sentiment.score_tokens(texts, lexicon, key="seq")
    joined = (
        unique.join(members, "seq", "left").join(flags.select("seq", "is_near_dup"), "seq").join(scores, "seq", "left")
        .withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))
        # Rows without a vector stay in the corpus as noise.
        .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(NOISE)))
        .withColumn("from_noise", F.coalesce("from_noise", F.lit(False)))
    )
    return stage(scoring.add_source_age(joined), "corpus"), stats


def run_record(
    stats: DataFrame, corpus: DataFrame, settings: FlowSettings, started_at: str, seconds: float,
    insights: DataFrame | None = None,
) -> DataFrame:
    """One row: start, duration, settings as JSON, and the counts of every stage."""
    noise = scoring.noise_stats(corpus)
    flagged = corpus.agg(F.count_if("is_near_dup").alias("n")).scalar()
    n_insights = F.lit(0).cast("bigint") if insights is None else insights.agg(F.count("*").alias("n")).scalar()
    return stats.select(
        F.lit(started_at).alias("started_at"),
        F.lit(round(seconds, 1)).alias("duration_s"),
        F.lit(json.dumps(asdict(settings))).alias("config"),
        F.struct("*").alias("clean"),
        flagged.alias("near_dups_flagged"),
        noise.select(F.struct("*")).scalar().alias("clustering"),
        n_insights.alias("clusters_analysed"),
    )


def analyse(
    corpus: DataFrame, answers: DataFrame | None = None, settings: FlowSettings = FlowSettings(),
    known: DataFrame | None = None, annotator: Callable[[dict], str] = annotate.extractive,
) -> tuple[DataFrame, DataFrame]:
    """(corpus, insights) for a prepared corpus.

    ``answers`` (cluster_id, raw) skips the annotator. All clusters are scored
    by one aggregation instead of one pass per cluster.
    """
    top = stage(scoring.top_clusters(corpus, settings.max_clusters), "top-clusters")
    pool = quotes.quote_pool(corpus.filter(F.col("cluster_id") != NOISE).join(top.select("cluster_id"), "cluster_id", "left_semi"))
    blocks = stage(quotes.prompt_blocks(quotes.quote_sample(pool, settings.max_quotes)), "quote-blocks")
    if answers is None:
        prompts = stage(quotes.cluster_prompts(blocks, scoring.cluster_summary(corpus)), "prompts")
        answers, _ = annotate.annotate_with_reuse(prompts, known, annotator)
    else:
        answers = answers.withColumn("prompt_key", F.sha2(F.encode("raw", "UTF-8"), 256)).withColumn(
            "cached", F.lit(False)
        )
    traced = annotate.traces(answers, "local", "extractive", F.current_timestamp())
    parsed = stage(annotate.parse(traced), "parsed")
    good = parsed.filter("valid")
    cited = good.select("cluster_id", F.col("analysis.evidence_quote_ids").alias("cited_ids"))
    verdicts = annotate.verify_citations(cited, corpus.filter(F.col("cluster_id") != NOISE))
    severity = good.select("cluster_id", F.col("analysis.severity").alias("severity")).join(
        top.select("cluster_id"), "cluster_id", "left_semi"
    )
    scored = scoring.score_clusters(corpus, severity, centroids.cohesion(corpus), settings.score)
    return corpus, stage(report.assemble(scored, parsed, verdicts, blocks), "insights")

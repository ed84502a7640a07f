"""Stratified evidence quotes and the prompt rows built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.measures import severity_prior
from themeloom.runtime import stage
from themeloom.schema import NOISE

PROMPT_VERSION = "themeloom-2"

SYSTEM_PROMPT = (
    "Fill in an annotation record for one group of user feedback. Every field is about the "
    "group as a whole. Keep texts short, name products and features as the quotes do, and "
    "take evidence_quote_ids from the ids shown in brackets only."
)
CLUSTER_PROMPT = (
    "%d feedback items (%s) were grouped together. %d sampled quotes follow, each with its "
    "id, source, optional star rating and date.\n\n%s\n\n"
    "Answer with JSON: theme_name, summary, root_causes (1-3), severity (1-5), "
    "severity_rationale, recommended_actions (1-3, each with action, effort "
    "low/medium/high, rationale) and evidence_quote_ids (3-6 of the ids above)."
)
SYNTHESIS_SYSTEM = (
    "Fill in a summary record over annotated feedback themes. Use the listed themes and "
    "nothing else."
)
SYNTHESIS_PROMPT = (
    "%d feedback items (%s) gave the themes below, each with priority (0-1), item count, "
    "severity (1-5) and confidence.\n\n%s\n\n"
    "Answer with JSON: headline, summary, cross_theme_observations, suggested_focus."
)


def quote_pool(df: DataFrame, minimum: int = 5) -> DataFrame:
    """Quotable members: originals only where a cluster has ``minimum`` of them,
    then dense-core members only where that pool has ``minimum`` of them."""
    original, core = ~F.col("is_near_dup"), ~F.col("from_noise")
    counts = df.groupBy("cluster_id").agg(
        F.count_if(original).alias("n_orig"),
        F.count_if(original & core).alias("n_orig_core"),
        F.count_if(core).alias("n_core"),
    )
    drop_dups = F.col("n_orig") >= minimum
    rules = stage(
        counts.select(
            "cluster_id",
            drop_dups.alias("_originals"),
            (F.when(drop_dups, F.col("n_orig_core")).otherwise(F.col("n_core")) >= minimum).alias("_cores"),
        ),
        "quote-rules",
    )
    return (
        df.join(rules, "cluster_id")
        .filter((~F.col("_originals") | original) & (~F.col("_cores") | core))
        .drop("_originals", "_cores")
    )


def _top(df: DataFrame, n: int, name: str, *order: Column) -> DataFrame:
    """Best ``n`` per cluster. Spark cuts to ``n`` per cluster and map task
    before the shuffle, so one huge cluster never lands whole in one task."""
    window = Window.partitionBy("cluster_id").orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def quote_sample(pool: DataFrame, max_quotes: int = 15) -> DataFrame:
    """At most ``max_quotes`` per cluster in citation order.

    Tier 1: nearest to the centroid; tier 2: most severe of the rest; tier 3:
    the first item of each source not yet covered. ``pool`` carries
    ``centroid_cos`` and the signal columns.
    """
    n_core = max(3, max_quotes // 2)
    n_chosen = max_quotes - 2
    rows = pool.filter(F.col("cluster_id") != NOISE).withColumn(
        "severity_prior", severity_prior(F.col("rating"), F.col("sentiment"))
    )
    keys = rows.select("cluster_id", "seq", "source", "centroid_cos", "severity_prior")
    near = _top(keys, n_core, "r", F.desc("centroid_cos"), F.asc("seq")).withColumn("kind", F.lit(1))
    severe = _top(keys, n_chosen + n_core, "r", F.desc("severity_prior"), F.asc("seq")).withColumn(
        "kind", F.lit(2)
    )
    # At most n_chosen sources are covered before tier 3, which adds at most
    # max_quotes more; later sources in name order can never be reached.
    firsts = keys.groupBy("cluster_id", "source").agg(F.min_by(F.struct(*keys.columns), "seq").alias("x"))
    cover = _top(firsts.select("x.*"), n_chosen + max_quotes, "r", F.asc("source")).withColumn(
        "kind", F.lit(3)
    )
    candidates = stage(near.unionByName(severe).unionByName(cover), "quote-candidates")

    # From here on every cluster has a constant number of rows.
    item = Window.partitionBy("cluster_id", "seq")
    cluster = Window.partitionBy("cluster_id")
    marked = candidates.withColumn("is_near", F.max(F.col("kind") == 1).over(item)).withColumn(
        "n_near", F.count_if(F.col("kind") == 1).over(cluster)
    )
    second = F.row_number().over(
        Window.partitionBy("cluster_id", (F.col("kind") == 2) & ~F.col("is_near")).orderBy("r")
    )
    marked = marked.withColumn(
        "picked",
        (F.col("kind") == 1)
        | (
            (F.col("kind") == 2)
            & ~F.col("is_near")
            & (second <= F.greatest(F.lit(0), F.lit(n_chosen) - F.col("n_near")))
        ),
    )
    covered = F.max("picked").over(Window.partitionBy("cluster_id", "source"))
    chosen = marked.withColumn("covered", covered).filter(
        F.col("picked") | ((F.col("kind") == 3) & ~F.col("covered"))
    )
    final = Window.partitionBy("cluster_id").orderBy("kind", "r")
    order = (
        chosen.withColumn("pos", F.row_number().over(final))
        .filter(F.col("pos") <= max_quotes)
        .select("cluster_id", "seq", "pos", F.col("kind").alias("tier"))
    )
    picks = stage(order, "quote-picks")
    return rows.join(picks, ["cluster_id", "seq"])


def quote_line() -> Column:
    """``[id] (source | rating: r/5 | date) text`` with optional parts."""
    rating = F.when(
        F.col("rating").isNotNull(),
        F.concat(F.lit(" | rating: "), F.bround("rating").cast("int").cast("string"), F.lit("/5")),
    )
    date = F.when(
        F.col("timestamp").isNotNull(), F.concat(F.lit(" | "), F.date_format("timestamp", "yyyy-MM-dd"))
    )
    return F.concat(
        F.lit("["), F.col("id"), F.lit("] ("), F.col("source"),
        F.coalesce(rating, F.lit("")), F.coalesce(date, F.lit("")), F.lit(") "), F.col("text"),
    )


def prompt_blocks(sample: DataFrame) -> DataFrame:
    """Quote count, quotes block and ordered quote records per cluster
    (at most ``max_quotes`` per row)."""
    quote = F.struct(
        "pos", "id", "text", "source",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "rating", "sentiment", quote_line().alias("line"),
    )
    ordered = sample.groupBy("cluster_id").agg(F.array_sort(F.collect_list(quote)).alias("q"))
    return ordered.select(
        "cluster_id",
        F.size("q").cast("bigint").alias("n_quotes"),
        F.array_join(F.transform("q", lambda x: x["line"]), "\n").alias("quotes_block"),
        F.transform(
            "q",
            lambda x: F.struct(
                x["id"].alias("id"), x["text"].alias("text"), x["source"].alias("source"),
                x["timestamp"].alias("timestamp"), x["rating"].alias("rating"),
                x["sentiment"].alias("sentiment"),
            ),
        ).alias("quotes"),
    )


def source_breakdown(counts: Column) -> Column:
    """``a: 5, b: 3`` by count descending, then name."""
    ranked = F.array_sort(
        F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("s"), e["value"].alias("n")))
    )
    return F.array_join(
        F.transform(ranked, lambda e: F.concat(e["s"], F.lit(": "), e["n"].cast("string"))), ", "
    )


def reuse_key(provider: str, model: str, schema_name: str, system: str, user: Column) -> Column:
    """SHA-256 over everything that shapes an answer, joined by U+001F."""
    parts = [F.lit(p) for p in (provider, model, PROMPT_VERSION, schema_name, system)]
    return F.sha2(F.encode(F.concat_ws("\u001f", *parts, user), "UTF-8"), 256)


def cluster_prompts(
    blocks: DataFrame, summary: DataFrame, provider: str = "local", model: str = "extractive"
) -> DataFrame:
    """One prompt row per cluster with its reuse key."""
    user = F.format_string(
        CLUSTER_PROMPT, F.col("n_items"), source_breakdown(F.col("sources")),
        F.col("n_quotes"), F.col("quotes_block"),
    )
    joined = blocks.join(summary.select("cluster_id", "n_items", "sources"), "cluster_id")
    return joined.withColumn("user_prompt", user).withColumn(
        "prompt_key", reuse_key(provider, model, "ClusterAnalysis", SYSTEM_PROMPT, F.col("user_prompt"))
    )

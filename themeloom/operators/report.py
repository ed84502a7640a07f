"""Insight records, tables, summaries and text renderings.

The insight table has at most one row per analysed cluster (capped by
``top_clusters``), so ordered lists over it are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.operators.explore import badge_label, source_label
from themeloom.operators.quotes import SYNTHESIS_PROMPT, SYNTHESIS_SYSTEM, reuse_key, source_breakdown
from themeloom.operators.scoring import rank_themes


def assemble(scored: DataFrame, parsed: DataFrame, verdicts: DataFrame, blocks: DataFrame) -> DataFrame:
    """One nested insight row per cluster. Members stay rows of the corpus keyed
    by cluster_id; only their number is in ``confidence``."""
    analysis = parsed.filter("valid").select("cluster_id", "analysis", "trace")
    quotes = blocks.select(
        "cluster_id", F.slice("quotes", 1, 8).alias("representative_quotes")
    )
    joined = (
        scored.drop("severity").join(analysis, "cluster_id").join(verdicts, "cluster_id").join(quotes, "cluster_id")
    )
    cited = F.col("analysis").withField("evidence_quote_ids", F.col("resolved_ids"))
    return joined.select(
        "cluster_id",
        cited.alias("analysis"),
        "priority_score", "score_components", "confidence", "per_source_counts",
        "representative_quotes", "citation_check_passed", "citation_check_detail",
        F.col("trace").alias("annotation_trace"),
    )


def insight_table(insights: DataFrame) -> DataFrame:
    return rank_themes(insights).select(
        F.col("rank"),
        F.col("analysis.theme_name").alias("theme"),
        F.col("priority_score").alias("priority"),
        F.col("analysis.severity").alias("severity"),
        F.col("confidence.n_items").alias("items"),
        badge_label(F.col("confidence.badge")).alias("confidence"),
        F.size("per_source_counts").cast("bigint").alias("sources"),
        F.when(F.col("citation_check_passed"), "✅").otherwise("❌").alias("citations_ok"),
        "cluster_id",
    )


def insight_detail(insights: DataFrame) -> DataFrame:
    """Quote cards of every theme: label, rating, date and cited mark."""
    return insights.select(
        "cluster_id",
        F.col("analysis.evidence_quote_ids").alias("cited"),
        F.posexplode("representative_quotes").alias("pos", "q"),
    ).select(
        "cluster_id", "pos",
        F.col("q.id").alias("id"),
        F.concat_ws(
            "  ·  ",
            source_label(F.col("q.source")),
            F.when(F.col("q.rating").isNotNull(),
                   F.concat(F.bround("q.rating").cast("int").cast("string"), F.lit("★"))),
            F.substring("q.timestamp", 1, 10),
        ).alias("meta"),
        F.array_contains("cited", F.col("q.id")).alias("starred"),
    )


def _bullets(items: Column, line) -> Column:
    return F.transform(items, line)


# Headings and line layouts in ``report_blocks``, ``report_header`` and
# ``grounding_text`` are the output contract of the report and of question answering.


def report_blocks(insights: DataFrame) -> DataFrame:
    """One Markdown section per theme, to be written in rank order."""
    a = "analysis."
    score = F.format_string(
        "**Priority %.2f** · severity %d/5 · %d items · %s",
        F.col("priority_score"), F.col(a + "severity"), F.col("confidence.n_items"),
        badge_label(F.col("confidence.badge")),
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col(a + "theme_name")),
            score, F.lit(""), F.col(a + "summary"), F.lit(""), F.lit("**Hypothesized root causes:**"),
        ),
        _bullets(F.col(a + "root_causes"), lambda x: F.concat(F.lit("- "), x)),
        F.array(F.lit(""), F.lit("**Recommended actions:**")),
        _bullets(
            F.col(a + "recommended_actions"),
            lambda x: F.concat(F.lit("- **"), x["action"], F.lit("** (effort: "), x["effort"],
                               F.lit(") — "), x["rationale"]),
        ),
        F.array(F.lit(""), F.lit("**Evidence sample:**")),
        _bullets(
            F.slice("representative_quotes", 1, 3),
            lambda q: F.concat(F.lit("> "), F.substring(q["text"], 1, 300), F.lit(" — _"), q["source"], F.lit("_")),
        ),
        F.array(F.lit("")),
    )
    return rank_themes(insights).select("rank", F.array_join(lines, "\n").alias("block"))


def report_header(summary: DataFrame, n_items: int | Column, generated: str) -> DataFrame:
    """The report part above the theme sections."""
    listed = F.when(
        F.size("cross_theme_observations") > 0,
        F.concat(
            F.array(F.lit("**Cross-theme observations:**")),
            F.transform("cross_theme_observations", lambda x: F.concat(F.lit("- "), x)),
            F.array(F.lit("")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(
            F.lit("# Product Feedback Insights Report"),
            F.concat(F.lit(f"_Generated {generated} from "), F.format_number(F.lit(n_items), 0), F.lit(" feedback items_")),
            F.lit(""), F.concat(F.lit("## "), F.col("headline")), F.lit(""), F.col("summary"), F.lit(""),
        ),
        listed,
        F.array(F.lit("**Suggested focus:**")),
        F.transform("suggested_focus", lambda x: F.concat(F.lit("- "), x)),
        F.array(F.lit("\n---\n")),
    )
    return summary.select(F.lit(0).alias("rank"), F.array_join(lines, "\n").alias("block"))


def fallback_summary(insights: DataFrame, prefer_ok: bool = True) -> DataFrame:
    """Deterministic summary of the top three themes with solid evidence, or of
    any three when no theme has it."""
    order = Window.orderBy(F.desc("priority_score"), "cluster_id")
    ok = F.col("confidence.badge") == "ok"
    rows = insights.select(
        "cluster_id", "priority_score", "confidence", F.col("analysis.theme_name").alias("name")
    )
    if prefer_ok:
        n_ok = rows.agg(F.count_if(ok).alias("n")).scalar()
        rows = rows.filter(ok | (n_ok == 0))
    top = rows.withColumn("r", F.row_number().over(order)).filter("r <= 3")
    names = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return top.agg(names.alias("t")).select(
        F.when(F.size("t") > 0, F.concat(F.lit("Top issue: "), F.get("t", F.lit(0))))
        .otherwise("No themes").alias("headline"),
        F.concat(
            F.lit("No synthesis is available for this run; the top priorities are: "),
            F.array_join("t", "; "), F.lit("."),
        ).alias("summary"),
        F.array().cast("array<string>").alias("cross_theme_observations"),
        F.col("t").alias("suggested_focus"),
    )


def _ordered_lines(insights: DataFrame, line: Column, limit: int | None = None) -> DataFrame:
    ranked = rank_themes(insights)
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))


def theme_line() -> Column:
    return F.format_string(
        "- %s (priority %.2f, n=%d, severity %d/5, confidence: %s): %s",
        F.col("analysis.theme_name"), F.col("priority_score"), F.col("confidence.n_items"),
        F.col("analysis.severity"), F.col("confidence.badge"), F.col("analysis.summary"),
    )


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """One row: total and per-source map (one entry per source type)."""
    return corpus.groupBy("source").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("n_items"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("per_source"),
    )


def synthesis_context(insights: DataFrame, corpus: DataFrame, provider: str = "local", model: str = "extractive") -> DataFrame:
    """The one prompt row of the executive summary with its reuse key."""
    totals = corpus_counts(corpus).select(F.struct("n_items", "per_source")).scalar()
    themes = _ordered_lines(insights, theme_line()).withColumn("c", totals)
    user = F.format_string(SYNTHESIS_PROMPT, F.col("c.n_items"), source_breakdown(F.col("c.per_source")), F.col("block"))
    return themes.select(
        F.col("block").alias("themes_block"), user.alias("user_prompt"),
        reuse_key(provider, model, "ExecutiveSummary", SYNTHESIS_SYSTEM, user).alias("prompt_key"),
    )


def grounding_text(insights: DataFrame, corpus: DataFrame, summary: DataFrame, top: int = 15) -> DataFrame:
    """Context for questions: corpus line, summary and the top themes."""
    a = "analysis."
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "),
        F.format_string(
            "%s — priority %.2f, severity %d/5, %d items, confidence: %s",
            F.col(a + "theme_name"), F.col("priority_score"), F.col(a + "severity"),
            F.col("confidence.n_items"), F.col("confidence.badge"),
        ),
        F.lit("\n   Summary: "), F.col(a + "summary"),
        F.lit("\n   Root causes: "), F.array_join(F.col(a + "root_causes"), " / "),
        F.lit("\n   Recommended actions: "),
        F.array_join(
            F.transform(
                F.col(a + "recommended_actions"),
                lambda x: F.concat(x["action"], F.lit(" (effort "), x["effort"], F.lit(")")),
            ),
            " / ",
        ),
    )
    totals = corpus_counts(corpus).select(F.struct("n_items", "per_source")).scalar()
    n_themes = insights.agg(F.count("*").alias("n")).scalar()
    text = summary.select("summary").scalar()
    themes = _ordered_lines(insights, line, top)
    head = F.concat(
        F.lit("Corpus: "), F.format_number(F.col("c.n_items"), 0), F.lit(" feedback items ("),
        source_breakdown(F.col("c.per_source")), F.lit("); "), F.col("k").cast("string"),
        F.lit(" analyzed themes."),
    )
    return themes.withColumn("c", totals).withColumn("k", n_themes).withColumn("s", text).select(
        F.concat_ws(
            "\n", head, F.concat(F.lit("Executive summary: "), F.col("s")), F.lit(""),
            F.lit("Ranked themes (by priority score 0-1):"), F.col("block"),
        ).alias("context")
    )

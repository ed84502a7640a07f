"""Theme annotations: hook, reuse by key, parsing, validation and citations."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import after_first_colon
from themeloom.operators.quotes import PROMPT_VERSION
from themeloom.runtime import stage
from themeloom.schema import ANNOTATION, EFFORTS

WORD = re.compile(r"[^\W\d_]{4,}")
# Sentences of the citation verdict, part of the output contract.
NOTHING_CITED = "LLM cited no evidence quotes"
UNKNOWN_CITED = ("LLM cited ", " unknown quote id(s): [", "]")
ALL_CITED = ("all ", " cited quote ids verified as cluster members")


def extractive(row: dict) -> str:
    """Default annotator: repeats what the quotes say, deterministically."""
    quotes = list(row["quotes"])
    words = Counter(w for q in quotes for w in set(WORD.findall(q["text"].lower())))
    terms = [w for w, _ in sorted(words.items(), key=lambda item: (-item[1], item[0]))[:3]]
    ratings = [q["rating"] for q in quotes if q["rating"] is not None and q["rating"] == q["rating"]]
    mood = [max(0.0, -(q["sentiment"] or 0.0)) for q in quotes]
    gloom = sum(5 - r for r in ratings) / len(ratings) if ratings else 4 * sum(mood) / max(len(mood), 1)
    severity = min(5, max(1, 1 + round(gloom)))
    theme = " / ".join(terms) or "untitled"
    return json.dumps(
        {
            "theme_name": theme,
            "summary": quotes[0]["text"] if quotes else "",
            "root_causes": [f"Possibly related to {term}" for term in terms] or ["Unknown"],
            "severity": severity,
            "severity_rationale": f"Based on {len(ratings)} ratings and {len(quotes)} quotes.",
            "recommended_actions": [
                {"action": f"Review feedback on {theme}", "effort": "low",
                 "rationale": "Confirm the theme before planning work."}
            ],
            "evidence_quote_ids": [q["id"] for q in quotes[:6]],
        },
        ensure_ascii=False,
    )


def annotate(prompts: DataFrame, fn: Callable[[dict], str] = extractive) -> DataFrame:
    """Runs ``fn`` on every prompt row (one per cluster) in Arrow batches.

    A failing call gives a null answer and an error text, so one bad cluster
    never stops the run. Task retries may repeat calls: write the result keyed
    by ``prompt_key`` before using it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for row in batch.to_dict("records"):
                try:
                    answers.append(fn(row))
                    errors.append(None)
                except Exception as exc:  # the hook is caller code
                    answers.append(None)
                    errors.append(str(exc))
            yield pd.DataFrame(
                {"cluster_id": batch["cluster_id"], "prompt_key": batch["prompt_key"],
                 "raw": answers, "error": errors}
            )

    return prompts.mapInPandas(run, "cluster_id int, prompt_key string, raw string, error string")


def annotate_with_reuse(
    prompts: DataFrame, known: DataFrame | None, fn: Callable[[dict], str] = extractive
) -> tuple[DataFrame, DataFrame]:
    """(answers for all prompts, new valid answers to append to the store).

    ``known`` holds (prompt_key, raw). Only missing keys are annotated.
    """
    if known is None:
        fresh = stage(annotate(prompts, fn), "annotations")
        answers = fresh.withColumn("cached", F.lit(False))
    else:
        store = known.groupBy("prompt_key").agg(F.min("raw").alias("raw"))
        keyed = prompts.select("cluster_id", "prompt_key").join(store, "prompt_key")
        missing = prompts.join(store, "prompt_key", "left_anti")
        fresh = stage(annotate(missing, fn), "annotations")
        hits = keyed.select("cluster_id", "prompt_key", "raw", F.lit(None).cast("string").alias("error"))
        answers = hits.withColumn("cached", F.lit(True)).unionByName(
            fresh.withColumn("cached", F.lit(False))
        )
    valid = parse(fresh).filter("valid").select("prompt_key", "raw")
    return answers, valid


def _valid(a: Column) -> Column:
    """Required fields, severity 1..5, 1-3 actions, known efforts."""
    actions = a["recommended_actions"]
    required = [
        a["theme_name"], a["summary"], a["root_causes"], a["severity"],
        a["severity_rationale"], actions, a["evidence_quote_ids"],
    ]
    present = required[0].isNotNull()
    for field in required[1:]:
        present = present & field.isNotNull()
    return F.coalesce(
        present
        & a["severity"].between(1, 5)
        & F.size(actions).between(1, 3)
        & F.forall(
            actions,
            lambda x: x["effort"].isin(*EFFORTS) & x["action"].isNotNull() & x["rationale"].isNotNull(),
        )
        & F.forall(a["root_causes"], lambda x: x.isNotNull())
        & F.forall(a["evidence_quote_ids"], lambda x: x.isNotNull()),
        F.lit(False),
    )


def parse(answers: DataFrame) -> DataFrame:
    """Adds ``analysis`` (struct) and ``valid``; invalid rows stay visible."""
    parsed = answers.withColumn(
        "analysis", F.from_json("raw", ANNOTATION, {"mode": "PERMISSIVE"})
    )
    return parsed.withColumn("valid", _valid(F.col("analysis")))


def traces(answers: DataFrame, provider: str, model: str, at: Column) -> DataFrame:
    """Provenance record per answer."""
    return answers.withColumn(
        "trace",
        F.struct(
            F.lit(provider).alias("provider"), F.lit(model).alias("model"),
            F.lit(PROMPT_VERSION).alias("prompt_version"),
            F.substring("prompt_key", 1, 16).alias("prompt_hash"),
            at.cast("string").alias("timestamp"), F.col("cached"), F.col("raw").alias("raw_response"),
        ),
    )


def resolve_citations(cited: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, pos, cited_id, resolved_id): a member id, or null.

    ``cited`` is (cluster_id, cited_ids). An equal id wins; else the single
    member whose part after the first colon equals it or whose id ends with it.
    Each member row meets only its own cluster's short citation list, matches
    are counted by combinable aggregates, and no member list is collected.
    """
    lists = stage(cited.select("cluster_id", "cited_ids"), "cited")
    wanted = lists.select("cluster_id", F.posexplode("cited_ids").alias("pos", "cited_id"))
    hits = (
        members.select("cluster_id", "id")
        .join(lists, "cluster_id")
        .withColumn("tail", after_first_colon(F.col("id")))
        .select(
            "cluster_id", "id",
            F.explode(
                F.filter(
                    F.array_distinct("cited_ids"),
                    lambda c: (c == F.col("id")) | (c == F.col("tail")) | F.endswith(F.col("id"), c),
                )
            ).alias("cited_id"),
        )
        .groupBy("cluster_id", "cited_id")
        .agg(
            F.bool_or(F.col("id") == F.col("cited_id")).alias("exact"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
    )
    resolved = F.when(F.col("exact"), F.col("cited_id")).when(
        F.col("first_id") == F.col("last_id"), F.col("first_id")
    )
    return wanted.join(hits, ["cluster_id", "cited_id"], "left").select(
        "cluster_id", "pos", "cited_id", resolved.alias("resolved_id")
    )


def verify_citations(cited: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, citation_check_passed, citation_check_detail, resolved_ids).

    Unresolved ids are kept as they are; three of them are reported, sorted.
    """
    rows = resolve_citations(cited, members)
    n = F.count("pos")
    unknown = F.sort_array(F.collect_list(F.when(F.col("resolved_id").isNull(), F.col("cited_id"))))
    ordered = F.array_sort(
        F.collect_list(F.struct("pos", F.coalesce("resolved_id", "cited_id").alias("id")))
    )
    verdict = rows.groupBy("cluster_id").agg(
        n.alias("n_cited"), unknown.alias("unknown"),
        F.transform(ordered, lambda x: x["id"]).alias("resolved_ids"),
    )
    n_unknown = F.size("unknown")
    some = F.array_join(
        F.transform(F.slice("unknown", 1, 3), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "
    )
    detail = (
        F.when(F.col("n_cited").isNull(), NOTHING_CITED)
        .when(
            n_unknown > 0,
            F.concat(F.lit(UNKNOWN_CITED[0]), n_unknown.cast("string"), F.lit(UNKNOWN_CITED[1]), some, F.lit(UNKNOWN_CITED[2])),
        )
        .otherwise(
            F.concat(F.lit(ALL_CITED[0]), F.col("n_cited").cast("string"), F.lit(ALL_CITED[1]))
        )
    )
    return (
        cited.select("cluster_id").join(verdict, "cluster_id", "left")
        .select(
            "cluster_id",
            (F.col("n_cited").isNotNull() & (n_unknown == 0)).alias("citation_check_passed"),
            detail.alias("citation_check_detail"),
            F.coalesce("resolved_ids", F.array().cast("array<string>")).alias("resolved_ids"),
        )
    )

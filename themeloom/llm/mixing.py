"""Raking token weights to source, language and topic marginals, then sampling.

The corpus is summed to cells (source, language, topic). Iterative proportional
fitting scales the cell weights to each target marginal in turn until all three
hold. The ratio of fitted to present share, times one constant that meets the token
budget, is the inclusion probability of every document of a cell, at most 1. The
draw compares it with a hash of the id, so it repeats exactly.

The topic of a document is the bucket of its most characteristic word: the word
with the largest count times inverse document frequency, from the frequencies of
all documents. Everything but two bounded tables (hashed document frequencies, and
one row of sums) stays in Spark: cells may be as many as the sources.

Results for odd rows: a null source or language is a value of its own; null and
empty texts have topic -1 and no tokens; rows that repeat an id share its draw, and
all null ids share one; an empty table gives an empty result. Targets that name a
value the corpus lacks are scaled over the values it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.words import chunk, column, mix, pieces
from themeloom.runtime import stage

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixSettings:
    """Topics, width of the frequency table, flattening exponent of the default
    targets, share of tokens to draw, when fitting stops, and sweeps written at once."""

    topics: int = 16
    width: int = 1 << 16
    flatten: float = 0.7
    budget: float = 0.8
    tolerance: float = 1e-3
    rounds: int = 60
    sweeps: int = 6
    seed: int = 17


def document_frequencies(docs: DataFrame, width: int) -> DataFrame:
    """bucket, df over all documents, and their number as bucket ``width``; a task sends
    at most ``width + 1`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1, np.int64)
        for batch in batches:
            total[width] += len(batch)
            for piece in pieces(column(batch, "text")):
                place = (mix(piece.marks) % np.uint64(width)).astype(np.int64)
                distinct = np.unique(piece.owner() * width + place)
                total += np.bincount(distinct % width, minlength=width + 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "df"])

    return docs.select("text").mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def describe(docs: DataFrame, settings: MixSettings) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of each row."""
    width, topics = settings.width, settings.topics
    seen = np.zeros(width + 1)
    for row in document_frequencies(docs, width).collect():
        seen[row.bucket] = row.df
    rarity = np.log((seen[width] + 1) / (seen[:width] + 1))

    def topic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                owner, marks = piece.owner(), piece.marks
                order = np.lexsort((marks, owner))
                owner, marks = owner[order], marks[order]
                fresh = np.ones(len(marks), bool)
                fresh[1:] = (marks[1:] != marks[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(fresh)
                times = np.diff(np.append(first, len(marks)))
                who, word = owner[first], marks[first]
                score = times * rarity[(mix(word) % np.uint64(width)).astype(np.int64)]
                best = np.lexsort((word, -score, who))
                leads = best[np.unique(who[best], return_index=True)[1]]
                topic = np.full(len(piece), -1, np.int64)
                topic[who[leads]] = (mix(word[leads] + np.uint64(1)) % np.uint64(topics)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(chunk(batch, c, piece) for c in ("doc_id", "source", "lang")), pa.array(topic), pa.array(piece.counts)],
                    ["doc_id", "source", "lang", "topic", "n_tokens"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return narrow.mapInArrow(topic_rows, "doc_id long, source string, lang string, topic long, n_tokens long")


def _key(name: str) -> Column:
    """A value as a key that joins when it is null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def cells_of(rows: DataFrame) -> DataFrame:
    """Tokens of each (source, lang, topic), keyed by margin columns of the same names."""
    return rows.groupBy(*[_key(m).alias(m) for m in MARGINS]).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def flat_targets(cells: DataFrame, exponent: float) -> dict[str, DataFrame]:
    """Default targets: present totals raised to a power below one."""
    return {
        m: cells.groupBy(m).agg(F.pow(F.sum("tokens"), F.lit(exponent)).alias("target")) for m in MARGINS
    }


def rake(cells: DataFrame, targets: dict[str, DataFrame], settings: MixSettings) -> DataFrame:
    """``cells`` with ``weight``, whose sums follow the targets on every margin.

    A window sums the cells (never the documents) of a margin value; a few sweeps are
    written at a time, so lineage stays short. The largest relative change of a weight
    in the last sweep tells when to stop. Cells without tokens keep weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    start = cells.withColumn("weight", F.col("tokens") / total)
    for m in MARGINS:
        goal = targets[m].join(cells.groupBy(m).agg(F.sum("tokens").alias("_t")).filter("_t > 0"), m)
        whole = goal.agg(F.sum("target")).first()[0] or 1.0
        start = start.join(goal.select(m, (F.col("target") / whole).alias(f"goal_{m}")), m, "left")
    fitted = stage(start, "rake")
    for _ in range(0, settings.rounds, settings.sweeps):
        moved = fitted
        for sweep in range(settings.sweeps):
            if sweep == settings.sweeps - 1:
                moved = moved.withColumn("before", F.col("weight"))
            for m in MARGINS:
                own = F.sum("weight").over(Window.partitionBy(m))
                scaled = F.when(own > 0, F.col("weight") * F.col(f"goal_{m}") / own)
                moved = moved.withColumn("weight", F.coalesce(scaled, F.lit(0.0)))
        moved = stage(moved, "rake")
        change = moved.filter("before > 0").agg(F.max(F.abs(F.col("weight") / F.col("before") - 1))).first()[0]
        fitted = moved.drop("before")
        if change is None or change < settings.tolerance:
            break
    return fitted.select(*MARGINS, "tokens", "weight")


def probabilities(fitted: DataFrame, settings: MixSettings) -> DataFrame:
    """``fitted`` with ``probability``: the weight ratio times the constant for which
    the expected tokens meet the budget, at most 1."""
    total, least = fitted.agg(
        F.sum("tokens"), F.min(F.when(F.col("weight") > 0, F.try_divide("weight", "tokens")))
    ).first()
    if not total or not least:
        return fitted.withColumn("probability", F.lit(1.0))
    ratio = F.try_divide("weight", "tokens")
    low, high = 0.0, 1.0 / least
    for _ in range(5):  # each round narrows the interval 32 times
        grid = [low + (high - low) * i / 32 for i in range(1, 32)]
        sums = fitted.filter("tokens > 0").agg(
            *[F.sum(F.least(F.lit(1.0), ratio * c) * F.col("tokens")).alias(f"c{i}") for i, c in enumerate(grid)]
        ).first()
        enough = sum(s < settings.budget * total for s in sums)
        low, high = ([low, *grid][enough], [*grid, high][enough])
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * high)).otherwise(F.lit(1.0))
    return fitted.withColumn("probability", chance)


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, settings: MixSettings | None = None) -> DataFrame:
    """Every row of ``docs`` with its topic, raked weight, probability and draw."""
    settings = settings or MixSettings()
    rows = stage(describe(docs, settings), "topics")
    cells = stage(cells_of(rows), "cells")
    fitted = rake(cells, targets or flat_targets(cells, settings.flatten), settings)
    chances = stage(probabilities(fitted, settings), "chances").select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS], F.try_divide("weight", "tokens").alias("_each"), "probability"
    )
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), "doc_id"), 11) / F.lit(float(1 << 53))
    on = [_key(m) == F.col(f"_{m}") for m in MARGINS]
    return rows.join(chances, on).select(
        "doc_id", "source", "lang", "topic", "n_tokens",
        (F.coalesce("_each", F.lit(0.0)) * F.col("n_tokens")).alias("weight"), "probability",
        (draw < F.col("probability")).alias("selected"),
    )


def keep_sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, settings: MixSettings | None = None) -> DataFrame:
    """Drawn rows of ``docs`` with all their columns."""
    drawn = sample(docs, targets, settings).filter("selected").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs.doc_id.eqNullSafe(drawn._drawn), "left_semi")

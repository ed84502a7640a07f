"""Length buckets with the least padding, and token-budget batches inside them.

The exact histogram of document lengths is all that reaches the driver: one row for
each distinct length, however many documents there are. Dynamic programming over it
finds the bucket bounds with the least total padding: for each number of buckets the
best cost is the lower hull of lines, so a bucket more is linear in the lengths.
Inside a bucket, documents in the order of their ids fill batches of
``budget // bound`` rows, so rows times padded length stay within the token budget.

Positions come from range slices with offsets, so a bucket with most of the
documents is spread over all tasks.

Results for odd rows: null and empty texts have length 0; rows that repeat an id or
have none are packed like others; a document longer than the budget is a batch of
its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.words import chunk, column, pieces
from themeloom.operators.ranking import spread_row_number
from themeloom.runtime import stage


@dataclass(frozen=True)
class PackSettings:
    buckets: int = 16
    budget: int = 8192


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` are distinct and ascending. The cost of a bucket over lengths i..j is
    lengths[j] * (documents) - (tokens), so the best start of a bucket that ends at j is
    the lowest of lines with slope -documents before i, asked at lengths[j]; slopes fall
    and questions rise, which a queue serves in constant time each.
    """
    n = len(lengths)
    docs, tokens = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        docs.append(docs[-1] + count)
        tokens.append(tokens[-1] + length * count)
    best: list[int | None] = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        lines: deque[tuple[int, int, int]] = deque()
        level: list[int | None] = [0] + [None] * n
        cut = [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                new = (-docs[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(lines) > 1:
                    (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                    if (new[1] - b1) * (m1 - m2) > (b2 - b1) * (m1 - new[0]):
                        break
                    lines.pop()
                lines.append(new)
            if not lines:
                continue
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            m, b, i = lines[0]
            level[j] = m * x + b + x * docs[j] - tokens[j]
            cut[j] = i
        cuts.append(cut)
        best = [None, *level[1:]] if n else level
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


def lengths_of(docs: DataFrame) -> DataFrame:
    """doc_id and length in words of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                yield pa.RecordBatch.from_arrays(
                    [chunk(batch, "doc_id", piece), pa.array(np.asarray(piece.counts, np.int64))], ["doc_id", "n_tokens"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def pack(docs: DataFrame, settings: PackSettings | None = None) -> DataFrame:
    """Each row with its bucket, batch and place in the batch.

    ``bucket`` is the padded length; ``batch`` counts from 0 inside a bucket; ``padding``
    is what the row adds up to its padded length.
    """
    settings = settings or PackSettings()
    rows = stage(lengths_of(docs), "lengths")
    histogram = sorted((r.n_tokens, r["count"]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = best_bounds([x for x, _ in histogram], [c for _, c in histogram], settings.buckets) or [0]
    limits = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.array_min(F.filter(limits, lambda b: b >= F.col("n_tokens")))
    placed = spread_row_number(
        rows.withColumn("bucket", bucket), ["bucket"], [F.col("doc_id"), F.col("n_tokens")], "_place", "long"
    )
    size = F.greatest(F.lit(1), F.floor(F.lit(settings.budget) / F.greatest("bucket", F.lit(1))).cast("long"))
    return placed.withColumn("_at", F.col("_place") - 1).select(
        "doc_id", "n_tokens", "bucket", F.floor(F.col("_at") / size).cast("long").alias("batch"),
        (F.col("_at") % size).alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )

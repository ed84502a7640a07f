"""Continuous ingest with the batch functions.

The batch side has no streaming operator to match; these variants exist because
feedback arrives continuously. Ranking stays a batch job over the written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themeloom.functions.text import text_hash
from themeloom.operators import centroids, cleaning
from themeloom.sources import raw


def mentions(stream: DataFrame, handle: str) -> DataFrame:
    """The chunked pre-filter of a raw export as a stateless stream."""
    return raw.inbound_mentions(stream, handle)


def clean(stream: DataFrame, min_chars: int = 15) -> DataFrame:
    return cleaning.keep_clean(cleaning.tag_drops(cleaning.add_clean_text(stream), min_chars))


def first_copies(stream: DataFrame, horizon: str = "7 days") -> DataFrame:
    """First arrival of each text within ``horizon``; state is dropped after it."""
    keyed = stream.withColumn("text_key", text_hash(F.col("text_clean")))
    return keyed.withWatermark("timestamp", horizon).dropDuplicatesWithinWatermark(["text_key"])


#: Stands for an unknown event time or ``seq``, which comes after all others.
NO_TIME = (1 << 63) - 1
DAY_MS = 86_400_000
#: Groups that the texts are dealt to; a call into Python costs far more than a row.
BUCKETS = 1 << 14
KNOWN = "text_keys array<string>, micros array<long>, seqs array<long>, ends array<long>"


def earliest_copies(stream: DataFrame, horizon_days: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(text_key, micros, seq) of the earliest copy of each text by event time (then by
    ``seq``), whatever the order of arrival: a text is sent again whenever an earlier
    copy of it turns up. Rows later than the horizon are dropped, and a text leaves the
    state when that can no longer happen to a copy of it.

    Texts share a group and its state by their hash, so that calls into Python are
    bounded by ``buckets`` a micro-batch. The state of a group is written anew when one of
    its texts arrives: take more buckets when the state is far larger than a micro-batch.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = max(state.getCurrentWatermarkMs(), 0)
        known = {k: (m, s, end) for k, m, s, end in zip(*state.get)} if state.exists else {}
        least: dict[str, tuple[int, int]] = {}
        if not state.hasTimedOut:
            for batch in batches:
                for text, *row in zip(*(batch[c].tolist() for c in ("text_key", "micros", "seq"))):
                    best = least.get(text)
                    if best is None or tuple(row) < best:
                        least[text] = tuple(row)
        found = []
        for text, best in least.items():
            before = known.get(text)
            if before is None or best < before[:2]:
                found.append((text, *best))
            else:
                best = before[:2]
            since = watermark if best[0] == NO_TIME else max(best[0] // 1000, watermark)
            known[text] = (*best, since + horizon_days * DAY_MS)
        known = {k: v for k, v in known.items() if k in least or v[2] >= watermark}
        if known:
            state.update((list(known), *map(list, zip(*known.values()))))
            state.setTimeoutTimestamp(max(min(v[2] for v in known.values()), watermark + 1))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["text_key", "micros", "seq"])

    micros = F.coalesce(F.unix_micros("timestamp"), F.lit(NO_TIME)).alias("micros")
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(NO_TIME)).alias("seq")
    keyed = stream.select(text_hash(F.col("text_clean")).alias("text_key"), "timestamp", micros, seq)
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(buckets)))
    found = (
        keyed.withWatermark("timestamp", f"{horizon_days} days").groupBy("bucket")
        .applyInPandasWithState(
            keep, "text_key string, micros long, seq long", KNOWN, "update", GroupStateTimeout.EventTimeTimeout
        )
    )
    return found.withColumn("seq", F.nullif("seq", F.lit(NO_TIME)))


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    """Writer of each micro-batch to a folder of its own, so that a replayed batch
    replaces its earlier output."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of rows written in update mode, the last one of each key."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("x"))
    return last.select(*keys, "x.*")


def daily_mentions(stream: DataFrame, late: str = "1 day", once: str | None = None) -> DataFrame:
    """Mentions per day and source; months are rolled up from days in batch. With
    ``once``, rows that repeat that key are counted once."""
    timed = stream.withWatermark("timestamp", late)
    return (
        (timed if once is None else timed.dropDuplicatesWithinWatermark([once]))
        .groupBy(F.window("timestamp", "1 day").alias("day"), "source")
        .agg(F.count("*").alias("mentions"))
        .select(F.col("day.start").alias("day"), "source", "mentions")
    )


def assign_to_themes(
    stream: DataFrame, cents: DataFrame, path: str, checkpoint: str, min_cosine: float = 0.55
) -> DataStreamWriter:
    """Writer that gives new vectors to their nearest known theme.

    Each micro-batch goes to its own folder, so a replayed batch replaces its
    earlier output.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = centroids.nearest_centroid(batch, cents)
        accept = F.coalesce(F.col("best_cos") >= min_cosine, F.lit(False))
        placed = found.withColumn("cluster_id", F.when(accept, F.col("best_id")).otherwise(-1))
        placed.drop("best_id", "best_cos").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

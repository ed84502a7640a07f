"""Exact copies by a minimal perfect hash over the digests already known.

Texts are equal when they are the same bytes after lower-casing A to Z; their
SHA-256 stands for them. The distinct digests of the history are split by digest
into shards of bounded size, and each shard gets a minimal perfect hash whose slots
hold the full digest, the locator of the row that stays, and the number of copies.
New digests are looked up in the shard they belong to and compared byte by byte:
members update their slot, the rest form groups of their own.

Rows are combined by digest on the map side before anything is shuffled, so a huge
group of copies is one row for each task; the join that hands each row its group
can be split by Spark at a hot digest.

Results for odd rows: null and empty texts are equal to each other; a null id ranks
below every other id; of rows that repeat id and text, one stays; an empty history
or table gives an empty index or result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm import perfect
from themeloom.llm.words import buffers, column
from themeloom.runtime import stage

SHARD_KEYS = 50_000
#: Stands for a null id inside slots.
NO_ID = -(1 << 63)
INDEX = "shard long, fields array<binary>, digests binary, ids binary, places binary, sizes binary"
GROUPS = "digest binary, keep_id long, keep_place long, group_size long, known boolean"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, place, digest for each row, written once: ``place`` tells rows apart
    that repeat an id."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = buffers(column(batch, "text"))
            found = [
                hashlib.sha256(data[a:b].tobytes().lower()).digest()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, digest binary")
    return stage(rows.withColumn("place", F.monotonically_increasing_id()), "digests")


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each distinct digest: the locator of the largest id, and the size."""
    row = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("place"))
    return rows.groupBy("digest").agg(F.max(row).alias("w"), F.count("*").alias("n")).select("digest", "w.*", "n")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


def _bytes(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, perfect.WIDTH)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of the grouped history."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = _bytes(part.digest)
        fields, slots = perfect.build(keys)
        order = np.argsort(slots)
        cells = [part[c].to_numpy(np.int64)[order].tobytes() for c in ("id", "place", "n")]
        return pd.DataFrame([[part.shard.iloc[0], fields, keys[order].tobytes(), *cells]], columns=_names(INDEX))

    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, INDEX)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def look_up(index: DataFrame, fresh: DataFrame, shards: int) -> DataFrame:
    """All groups after the new digests went through the index."""

    def find(known: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(known):
            row = known.iloc[0]
            keys = np.frombuffer(row.digests, np.uint8).reshape(-1, perfect.WIDTH)
            ids, places, sizes = (np.frombuffer(row[c], np.int64).copy() for c in ("ids", "places", "sizes"))
            fields = list(row.fields)
        else:
            keys, fields = np.zeros((0, perfect.WIDTH), np.uint8), []
            ids = places = sizes = np.zeros(0, np.int64)
        asked = _bytes(new.digest)
        slots = perfect.find(fields, asked)
        member = slots >= 0
        member[member] = (keys[slots[member]] == asked[member]).all(axis=1)
        new_ids, new_places, new_sizes = (new[c].to_numpy(np.int64) for c in ("id", "place", "n"))
        at = slots[member]
        if len(at):
            later = (new_ids[member] > ids[at]) | ((new_ids[member] == ids[at]) & (new_places[member] > places[at]))
            sizes[at] += new_sizes[member]
            ids[at[later]], places[at[later]] = new_ids[member][later], new_places[member][later]
        return pd.DataFrame({
            "digest": [k.tobytes() for k in keys] + list(new.digest[~member]),
            "keep_id": np.concatenate([ids, new_ids[~member]]),
            "keep_place": np.concatenate([places, new_places[~member]]),
            "group_size": np.concatenate([sizes, new_sizes[~member]]),
            "known": np.arange(len(keys) + int((~member).sum())) < len(keys),
        })

    return (
        index.groupBy("shard").cogroup(fresh.withColumn("shard", _shard(shards)).groupBy("shard"))
        .applyInPandas(find, GROUPS)
    )


def groups(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Groups of equal texts of ``history`` and ``fresh`` (rows of ``digests``)."""
    old = stage(_grouped(history), "known-digests")
    partitions = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-old.count() // SHARD_KEYS))
    index = stage(build_index(old, shards), "digest-index")
    return look_up(index, _grouped(fresh), shards)


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as history and news: ids up to the middle of their range, and the rest."""
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(None if low is None else (low + high) // 2).cast("long")
    known = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return rows.filter(known), rows.filter(~known)


def decide(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of ``digests`` with its group and whether it is the one that stays."""
    stays = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("keep_id")) & (F.col("place") == F.col("keep_place"))
    return rows.join(found, "digest").select(
        "doc_id", F.nullif("keep_id", F.lit(NO_ID)).alias("keep_id"), "group_size", stays.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("known").alias("in_history"),
    )


def copies(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the row that stays for its text."""
    rows = digests(docs)
    return decide(rows, groups(*halves(rows)))


def _lowered() -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()), 256))


def drop_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    Wide rows are matched on their id, which is no hot key. Ids that occur more than
    once are matched on their digest too, and of equal rows one is taken, combined
    on the map side first.
    """
    rows = digests(docs)
    found = stage(groups(*halves(rows)), "digest-groups")
    stay = found.select(F.nullif("keep_id", F.lit(NO_ID)).alias("_stay"), F.col("digest").alias("_digest"))
    again = stage(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return docs.join(stay, docs.doc_id.eqNullSafe(stay._stay), "left_semi")
    repeated = again.select(F.col("doc_id").alias("_again"))
    is_repeated = docs.doc_id.eqNullSafe(repeated._again)
    once = docs.join(repeated, is_repeated, "left_anti")
    once = once.join(stay, once.doc_id.eqNullSafe(stay._stay), "left_semi")
    many = docs.join(repeated, is_repeated, "left_semi").select(
        F.col("doc_id").alias("_id"), _lowered().alias("_key"), F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    )
    many = many.groupBy("_id", "_key").agg(F.first("_row").alias("_row"))
    many = many.join(stay, many._id.eqNullSafe(stay._stay) & (many._key == stay._digest), "left_semi")
    return once.unionByName(many.select("_row.*"))

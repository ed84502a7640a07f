"""Fetching the texts of chosen documents without moving all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the id map; its table has at most a 64th as many rows (2 MB) and is broadcast.
BITS = 1 << 23


def likely(docs: DataFrame, ids: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` may be in ``ids``, without a shuffle of ``docs``.

    The ids are folded into a bit map of fixed size, so what is broadcast is bounded
    however many ids there are. All rows with a wanted id pass; others pass by chance,
    the more the fuller the map is, so a join on the id has to follow. Null ids pass
    when ``ids`` has a null.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word = F.floor(place / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = (
        ids.select("doc_id").select(word.alias("_word"), bit.alias("_bit"))
        .groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    )
    found = docs.join(F.broadcast(words), word == F.col("_word"))
    return found.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*[docs[c] for c in docs.columns])

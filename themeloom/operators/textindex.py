"""Regular-expression search by an inverted index of character trigrams.

A search first derives what a text must contain to match: alternatives, each a set of
trigrams that all have to occur. Postings say for every trigram and block of rows which
rows of the block have it, in lists of a few MB of text each; those of the rarest trigrams
are intersected block by block, and only rows that are left are fetched and matched. A pattern that demands no
trigram, or that this module does not understand, is matched against every row.

Letters are folded so that nothing that matches in any case is missed: ASCII letters
become small, the few others that match an ASCII letter in another case become it, and
all other characters outside ASCII are one placeholder.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.operators.ranking import spread_row_number

#: Rows of a block, unless the table is so small that it would have too few of them.
BLOCK_ROWS = 65_536
LEAST_BLOCKS = 64
#: Strings a part of a pattern may stand for, and alternatives of a whole pattern.
MOST_STRINGS, MOST_ALTERNATIVES = 16, 32
#: Bytes of text whose trigrams are listed at once.
LIST_BYTES = 1 << 20
#: Trigrams of an alternative whose postings are read: the rarest.
RAREST = 3
#: Blocks named in the filter of the scan; more are found by a join.
NAMED_BLOCKS = 2_000

# Characters outside ASCII that match an ASCII letter in another case
# (long s, Kelvin sign, dotted I, dotless i).
CASED = {"ſ": "s", "K": "k", "İ": "i", "ı": "i"}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER = "\u0001"

Need = list[frozenset[str]]


def _fold(text: str) -> str:
    small = "".join(CASED.get(c, c.lower() if c in UPPER else c) for c in text)
    return re.sub(r"[^\x00-\x7F]", OTHER, small)


def _fold_bytes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_fold`` of UTF-8 bytes, one byte a character, and the places that the characters begin at."""
    small = np.arange(256, dtype=np.uint8)
    small[[ord(c) for c in UPPER]] = [ord(c) for c in UPPER.lower()]
    small[0x80:] = ord(OTHER)
    out, at = small[text], np.flatnonzero(text & 0xC0 != 0x80)
    leads = at[text[at] > 0xC1]
    for char, letter in CASED.items():
        first, *rest = char.encode()
        met = leads[text[leads] == first]
        for i, byte in enumerate(rest, 1):
            met = met[text[met + i] == byte]
        out[met] = ord(letter)
    return out[at], at


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(strings: Iterable[str]) -> Need:
    return _short([_trigrams(s) for s in strings])


def _short(need: Need) -> Need:
    """Without alternatives that ask for more than another one."""
    found: Need = []
    for one in sorted(set(need), key=len):
        if not any(kept <= one for kept in found):
            found.append(one)
    return found


def _both(a: Need, b: Need) -> Need:
    if len(a) * len(b) > MOST_ALTERNATIVES:
        return max((a, b), key=lambda need: min(map(len, need)))
    return _short([x | y for x, y in product(a, b)])


def _walk(items) -> tuple[set[str] | None, Need]:
    """The strings that a sequence of pattern parts stands for if they are few, and what
    a text must contain."""
    strings, need, known = {""}, [frozenset()], True
    for kind, value in items:
        own, own_need = _part(kind, value)
        if own is not None and len(own) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a, b in product(strings, own)}
            continue
        need = _both(_both(need, _any(strings)), own_need if own is None else _any(own))
        strings, known = {""}, False
    if known:
        return strings, _any(strings)
    return None, _both(need, _any(strings))


def _part(kind, value) -> tuple[set[str] | None, Need]:
    nothing: Need = [frozenset()]
    if kind is kinds.LITERAL:
        return {_fold(chr(value))}, nothing
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return {""}, nothing
    if kind is kinds.SUBPATTERN:
        return _walk(value[3])
    if kind is kinds.ATOMIC_GROUP:
        return _walk(value)
    if kind is kinds.BRANCH:
        found = [_walk(x) for x in value[1]]
        if all(own is not None for own, _ in found):
            union = set().union(*[own for own, _ in found])
            if len(union) <= MOST_STRINGS:
                return union, _any(union)
        need = _short([x for _, part in found for x in part])
        return None, need if len(need) <= MOST_ALTERNATIVES else nothing
    if kind is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
        return {_fold(chr(c)) for _, c in value}, nothing
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
        low, high, inner = value
        own, need = _walk(inner)
        if low == high == 1:
            return own, need
        return None, need if low >= 1 else nothing
    return None, nothing


def required(pattern: str) -> Need | None:
    """Alternatives of trigrams, one of which a matching text has in full; none if any
    text may match. Patterns that only the JVM's syntax allows give none too."""
    if "&&" in pattern or "{g}" in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            need = _walk(parser.parse(pattern))[1]
    except (re.error, Warning, OverflowError, RecursionError):
        return None
    return need if all(need) else None


def _block_of(starts: list[int]):
    """The block of a key, by the first keys of the blocks; rows without one are in the first."""
    bounds = np.array(starts, dtype=np.int64)

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds, keys.to_numpy(np.int64), "right") - 1, 0))

    return lambda key: run(F.coalesce(key.cast("long"), F.lit(-(1 << 63))))


POSTINGS = "gram string, block long, rows array<int>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each trigram of the texts (block, row, text), for about LIST_BYTES of rows of
    one block at a time."""
    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
        text = batch.column(2).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        start = 0
        while start < len(batch):
            others = np.flatnonzero(blocks[start:] != blocks[start])
            stop = start + int(others[0]) if len(others) else len(batch)
            stop = min(stop, max(start + 1, int(np.searchsorted(ends, ends[start] + LIST_BYTES, "right")) - 1))
            chars, at = _fold_bytes(np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[start] : ends[stop]])
            if len(chars) > 2:
                row = np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(ends[start : stop + 1]))[at]
                met = chars[:-2].astype(np.int64)
                for shift, part in ((8, chars[1:-1]), (8, chars[2:]), (32, row[:-2])):
                    met <<= shift
                    met |= part
                met = met[row[:-2] == row[2:]]
                met.sort()
                met = met[np.flatnonzero(np.diff(met, prepend=-1))]
                codes, found = met >> 32, rows[start + (met & 0xFFFFFFFF)]
                first = np.flatnonzero(np.diff(codes, prepend=-1))
                grams = np.stack([codes[first] >> 16, codes[first] >> 8 & 255, codes[first] & 255], axis=1).astype(np.uint8)
                names = pa.StringArray.from_buffers(
                    len(first), pa.py_buffer(np.arange(0, 3 * len(first) + 1, 3, np.int32).tobytes()), pa.py_buffer(grams.tobytes())
                )
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(met)), pa.int32()), pa.array(found, pa.int32()))
                block = pa.array(np.full(len(first), blocks[start]), pa.int64())
                yield pa.RecordBatch.from_arrays([names, block, lists], ["gram", "block", "rows"])
            start = stop


@dataclass(frozen=True)
class TextIndex:
    """Folders of the rows by block, of the postings by trigram and of their counts."""

    rows: str
    postings: str
    counts: str

    @classmethod
    def build(cls, df: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> TextIndex:
        """Writes the index of ``df`` (``seq`` unique, ``text``) below ``path``."""
        index = cls(f"{path}/rows", f"{path}/postings", f"{path}/counts")
        spark = df.sparkSession
        # Only the keys are numbered; the rows move once, each to its block.
        numbered = spread_row_number(df.select("seq"), [], [F.asc("seq")], "_no", "long")
        span = max(1, min(block_rows, -(-df.count() // LEAST_BLOCKS)))
        heads = numbered.filter((F.col("_no") - 1) % span == 0).select("seq").collect()  # one a block
        starts = sorted({r.seq for r in heads if r.seq is not None})
        placed = df.withColumn("_block", _block_of(starts)(F.col("seq"))).repartition("_block")
        row = F.row_number().over(Window.partitionBy("_block").orderBy("seq")) - 1
        placed.withColumn("_row", row).select(*df.columns, "_block", "_row").write.option("compression", "zstd").partitionBy("_block").parquet(index.rows)
        rows = spark.read.parquet(index.rows).select(
            F.col("_block").cast("long"), "_row", F.coalesce(F.make_valid_utf8("text"), F.lit("")).alias("text")
        )
        lists = rows.mapInArrow(_lists, POSTINGS)  # in the memory of a batch, however large a block is
        lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(index.postings)
        counts = spark.read.parquet(index.postings).groupBy("gram").agg(F.sum(F.size("rows")).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(index.counts)
        return index

    def candidates(self, spark: SparkSession, need: Need) -> DataFrame:
        """(block, row) of the rows that have all trigrams of an alternative."""
        asked = sorted(set().union(*need))
        known = spark.read.parquet(self.counts).filter(F.col("gram").isin(asked))
        counts = {r.gram: r.n for r in known.collect()}  # as many as the pattern has
        chosen = [sorted(one, key=lambda g: (counts[g], g))[:RAREST] for one in need if all(g in counts for g in one)]
        read = sorted({g for one in chosen for g in one})
        if not read:
            return spark.createDataFrame([], "block long, row int")
        lists = spark.read.parquet(self.postings).filter(F.col("gram").isin(read))
        none = F.array().cast("array<int>")
        wide = lists.groupBy("block").agg(*[
            F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("rows")))).alias(f"g{i}")  # at most a block
            for i, g in enumerate(read)
        ])
        met = none
        for one in chosen:
            rows = F.col(f"g{read.index(one[0])}")
            for g in one[1:]:
                rows = F.array_intersect(rows, F.col(f"g{read.index(g)}"))
            met = F.array_union(met, rows)
        return wide.select("block", F.explode(met).alias("row"))

    def fetch(self, spark: SparkSession, pattern: str) -> DataFrame:
        """The rows that may match; all of them for a pattern that demands nothing."""
        rows = spark.read.parquet(self.rows)
        need = required(pattern)
        if need is None:
            return rows.drop("_block", "_row")
        places = self.candidates(spark, need)
        blocks = [r.block for r in places.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        if len(blocks) <= NAMED_BLOCKS:
            rows = rows.filter(F.col("_block").isin(blocks))
        same = (rows._block == places.block) & (rows._row == places.row)
        return rows.join(places, same, "left_semi").drop("_block", "_row")


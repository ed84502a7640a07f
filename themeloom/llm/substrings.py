"""Removal of long passages that an earlier document already has.

Every window of 50 words is anchored at the smallest of its 20-word fingerprints, and
neighbouring windows with one anchor are a segment. Equal windows have equal anchors,
so only segments whose anchor occurs again can hold a repeated window. Equal segments
are one (their smallest document stands for them); the different segments of an anchor
go to the shard of the anchor, which builds an FM-index over its segments and streams
them backwards through it: matching statistics tell for each word how far the text
before it occurs elsewhere, and windows that reach 50 words in a smaller document are
reported as intervals. An anchor with very many different segments is split further:
its windows are grouped by their own fingerprint.

The work of an anchor that a third of all documents share is thus combined on the map
side, and a shard holds a bounded number of words. Texts are shuffled by document,
never by content.

Windows are judged on the input. Words and segments are compared by 64-bit
fingerprints. Results for odd rows: null and empty texts have no words; equal texts
under one id remove nothing from each other; a null id counts as larger than any
other; rows that repeat an id are judged by their own text; an empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.fmindex import FMIndex
from themeloom.llm.lookups import likely
from themeloom.llm.words import Piece, chunk, column, fingerprints, grams, mix, pieces, words_of
from themeloom.runtime import stage

LAST_ID = (1 << 63) - 1
DOCS = (
    "doc_id long, n_words long, kept_sha256 string, "
    "anchors array<long>, contents array<long>, starts array<int>, sizes array<int>"
)
CUTS = "shard_key long, doc_id long, content long, shift int, segment string"
FOUND = "content long, first int, last int"


@dataclass(frozen=True)
class SubstringSettings:
    """Window and anchor length in words, words of a shard, and the number of different
    segments up to which an anchor goes to a shard whole."""

    window: int = 50
    anchor: int = 20
    shard_words: int = 500_000
    hot_segments: int = 4096


def sequence_marks(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of the words [start, end), whatever their position."""
    base = 0xA24BAED4963EE407
    powers = np.full(len(marks) + 1, base, np.uint64)
    inverses = np.full(len(marks) + 1, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverses[0] = 1
    powers, inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    sums = np.zeros(len(marks) + 1, np.uint64)
    np.cumsum(marks * powers[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def segments_of(piece: Piece, settings: SubstringSettings) -> tuple[np.ndarray, ...]:
    """Document, anchor, content mark, start and size of each segment of a piece."""
    n, window, k = len(piece.marks), settings.window, settings.anchor
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    values = grams(piece.marks, k)
    places = np.arange(len(values))
    width, whole = 1, window - k + 1
    while width < whole:
        step = min(width, whole - width)
        later = values[step:] < values[:-step]
        values = np.where(later, values[step:], values[:-step])
        places = np.where(later, places[step:], places[:-step])
        width += step
    owner = piece.owner()
    inside = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    anchor, whose = places[inside], owner[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (whose[1:] != whose[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(inside)) - 1
    a, b = inside[first], inside[last] + window
    content = sequence_marks(piece.marks, a, b)
    return whose[first], values[a].view(np.int64), content.view(np.int64), a - piece.begins[whose[first]], b - a


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray | None = None) -> bytes:
    """Words joined by one space."""
    if kept is not None:
        starts, ends = starts[kept], ends[kept]
    raw = data.tobytes()
    return b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def _ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def anchored(docs: DataFrame, settings: SubstringSettings) -> DataFrame:
    """One row for each document: words, digest of all its words, and its segments."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(column(batch, "text")):
                whose, anchor, content, start, size = segments_of(piece, settings)
                bounds = np.searchsorted(whose, np.arange(len(piece) + 1))
                whole = []
                for a, b in zip(piece.bounds[:-1], piece.bounds[1:], strict=True):
                    whole.append(hashlib.sha256(b" ".join(piece.data[a:b].tobytes().split())).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk(batch, "doc_id", piece), pa.array(piece.counts, pa.int64()), pa.array(whole),
                        _ragged(anchor, bounds, pa.int64()), _ragged(content, bounds, pa.int64()),
                        _ragged(start, bounds, pa.int32()), _ragged(size, bounds, pa.int32()),
                    ],
                    [x.split()[0] for x in DOCS.split(", ")],
                )

    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id")
    return docs.select(ids, "text").mapInArrow(build, DOCS)


def shared_segments(rows: DataFrame) -> DataFrame:
    """doc_id, anchor, content, start, size of segments whose anchor occurs again."""
    each = rows.select(
        "doc_id", F.explode(F.arrays_zip("anchors", "contents", "starts", "sizes")).alias("s")
    ).select(
        "doc_id", F.col("s.anchors").alias("anchor"), F.col("s.contents").alias("content"),
        F.col("s.starts").alias("start"), F.col("s.sizes").alias("size"),
    )
    again = rows.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().filter("count > 1")
    return each.join(again.select("anchor"), "anchor")


def owners(shared: DataFrame) -> DataFrame:
    """One row for each different segment: its anchor and where its smallest document
    has it, and how many different segments the anchor has."""
    one = shared.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start", "size")).alias("o"))
    many = one.groupBy("anchor").agg(F.count("*").alias("different"))
    return one.join(many, "anchor").select("anchor", "content", "o.*", "different")


def cut(docs: DataFrame, wanted: DataFrame, settings: SubstringSettings) -> DataFrame:
    """Words of the wanted segments, keyed by the shard they belong to; of hot anchors
    the fingerprints of their windows instead of words."""
    window = settings.window
    lists = wanted.groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "content", "start", "size", "hot")).alias("wanted")
    )
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            lists = column(batch, "wanted")
            for piece in pieces(column(batch, "text")):
                out: list[tuple] = []
                for i in range(len(piece)):
                    a, b = piece.begins[i], piece.begins[i + 1]
                    starts, ends, marks = piece.starts[a:b], piece.ends[a:b], piece.marks[a:b]
                    asked = lists[piece.first + i].values
                    anchor, content, start, size, hot = (
                        np.asarray(asked.field(f)) for f in ("anchor", "content", "start", "size", "hot")
                    )
                    fits = start + size <= len(marks)
                    same = np.zeros(len(start), bool)
                    same[fits] = sequence_marks(marks, start[fits], (start + size)[fits]).view(np.int64) == content[fits]
                    for j in np.flatnonzero(same):
                        s, e = int(start[j]), int(start[j] + size[j])
                        if hot[j]:
                            at = np.arange(s, e - window + 1)
                            keys = sequence_marks(marks, at, at + window).view(np.int64)
                            out += [(int(k), ids[piece.first + i], int(content[j]), n, None) for n, k in enumerate(keys)]
                        else:
                            words = piece.data[starts[s] : ends[e - 1]].tobytes().split()
                            text = b" ".join(words).decode()
                            out.append((int(anchor[j]), ids[piece.first + i], int(content[j]), 0, text))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        [x.split()[0] for x in CUTS.split(", ")],
                    )

    return likely(texts, wanted).join(lists.hint("merge"), "doc_id").mapInArrow(take, CUTS)


def _intervals(content: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Runs of neighbouring window starts of one content."""
    order = np.lexsort((start, content))
    content, start = content[order], start[order]
    fresh = np.ones(len(content), bool)
    fresh[1:] = (content[1:] != content[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(content)) - 1 if len(content) else first
    return pd.DataFrame({"content": content[first], "first": start[first], "last": start[last]})


def search(cuts: DataFrame, shards: int, settings: SubstringSettings) -> DataFrame:
    """Intervals of window starts, inside each segment, that a smaller document has."""
    window = settings.window

    def one_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("content")
        joined = " ".join(part.segment).encode()
        data = np.frombuffer(joined, np.uint8)
        starts, ends = words_of(data, np.array([0, len(data)]))
        sizes = part.segment.str.count(" ").to_numpy() + 1
        bounds = np.append(0, np.cumsum(sizes))
        _, symbols = np.unique(fingerprints(data, starts, ends), return_inverse=True)
        symbols = symbols + 1
        labels, ranks = np.unique(part.doc_id.to_numpy(np.int64), return_inverse=True)
        index = FMIndex(symbols, bounds, int(symbols.max()) + 1, ranks)
        windows = sizes - window + 1
        whose = np.repeat(np.arange(len(sizes)), windows)
        start = np.arange(len(whose)) - np.repeat(np.cumsum(windows) - windows, windows)
        _, smaller = index.suffix_matches(symbols, bounds[whose] + start + window, ranks[whose], window)
        return _intervals(part.content.to_numpy(np.int64)[whose[smaller]], start[smaller])

    shard = F.pmod(F.xxhash64("shard_key"), F.lit(shards)).alias("shard")
    return cuts.select("*", shard).groupBy("shard").applyInPandas(one_shard, FOUND)


def search_hot(cuts: DataFrame) -> DataFrame:
    """The same for windows of hot anchors: equal windows meet by their fingerprint."""
    least = cuts.groupBy("shard_key").agg(F.min("doc_id").alias("_least"))
    later = cuts.join(least, "shard_key").filter("doc_id > _least")
    return later.select("content", F.col("shift").alias("first"), F.col("shift").alias("last"))


def repeated(docs: DataFrame, rows: DataFrame, settings: SubstringSettings) -> DataFrame:
    """doc_id and its repeated windows: content, start and size of the segment they are
    in, and the first and last window start inside it."""
    window = settings.window
    shared = stage(shared_segments(rows), "shared-segments")
    own = stage(owners(shared), "segment-owners")
    wanted = own.filter("different > 1").withColumn("hot", F.col("different") > settings.hot_segments)
    cuts = stage(cut(docs, wanted, settings), "segments")
    words = wanted.filter("NOT hot").agg(F.sum("size")).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-words // settings.shard_words))
    found = search(cuts.filter("segment IS NOT NULL"), shards, settings).union(search_hot(cuts.filter("segment IS NULL")))
    inner = stage(found, "repeated-windows")
    least = own.select("anchor", "content", F.col("doc_id").alias("_least"))
    placed = shared.join(least, ["anchor", "content"])
    copies = placed.filter("doc_id > _least").select(
        "doc_id", "content", "start", "size", F.lit(0).alias("first"), (F.col("size") - window).alias("last")
    )
    firsts = placed.filter("doc_id = _least").join(inner, "content").select(
        "doc_id", "content", "start", "size", "first", "last"
    )
    return copies.union(firsts)


def strip_passages(docs: DataFrame, settings: SubstringSettings | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of each row (null text:
    nothing was removed, the text stands as it is)."""
    settings = settings or SubstringSettings()
    window = settings.window
    rows = stage(anchored(docs, settings), "anchored")
    marks = stage(
        repeated(docs, rows, settings).groupBy("doc_id").agg(
            F.collect_list(F.struct("content", "start", "size", "first", "last")).alias("repeats")
        ),
        "repeats",
    )
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), "text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "repeats")
            for piece in pieces(column(batch, "text")):
                removed, digests, kept_texts = [], [], []
                for i in range(len(piece)):
                    a, b = piece.begins[i], piece.begins[i + 1]
                    n = b - a
                    own = piece.marks[a:b]
                    asked = lists[piece.first + i].values
                    content, start, size, first, last = (
                        np.asarray(asked.field(f)) for f in ("content", "start", "size", "first", "last")
                    )
                    fits = start + size <= n
                    content, start, size, first, last = (x[fits] for x in (content, start, size, first, last))
                    same = sequence_marks(own, start, start + size).view(np.int64) == content
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, (start + first)[same], 1)
                    np.add.at(change, (start + last)[same] + window, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = _joined(piece.data, piece.starts[a:b], piece.ends[a:b], ~gone)
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk(batch, "doc_id", piece), pa.array(piece.counts, pa.int64()), pa.array(removed, pa.int64()),
                        pa.array(digests), pa.array(kept_texts),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    changed = likely(texts, marks).join(marks.hint("merge"), "doc_id").mapInArrow(
        strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    same = rows.join(marks.select("doc_id").hint("merge"), "doc_id", "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text")
    )
    return same.union(changed).withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))

"""Quality rules: n-gram likelihood ratio of trusted and raw text.

Unigrams and bigrams of *all* documents are counted under their 64-bit fingerprints,
once for the whole corpus and once for the trusted documents; equal texts count once,
and are trusted when a copy is. A document gets the mean log ratio of its n-grams,
without its own counts in either of the two: an n-gram that no other text has says
nothing, and one that others have is drawn to the share of trusted text in the corpus
with the weight of ``prior`` occurrences. The document is kept when the mean reaches a
fixed threshold: no sampling and no random draw. Surface rules (too few words,
repetition) come first.

The distinct texts are dealt to bundles by the hash of the text. A bundle asks for each of
its different n-grams once; the questions meet in slices of the fingerprints, and the
answers go back to the bundle, which holds its texts still and adds up the ratios. Bundles
and slices are groups of bounded size whose number follows the size of the texts, what
moves is one number for each n-gram of a bundle and no sums of single texts, and no table
of n-grams reaches the driver or all tasks.

Results for odd rows: null and empty texts have no words, score 0 and fail the
word rule; repeated rows get equal verdicts; a null id is never trusted; an empty
table gives an empty result; without trusted rows all scores are 0, so only the
surface rules decide. All columns pass
through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.words import Piece, buffers, chunk, column, grams_inside, mix, pieces
from themeloom.runtime import stage

SYMBOLS = b"#*$%&|<>"
VERDICT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, n_grams long, score double, kept boolean"
)
SURFACE = VERDICT.replace("score double, kept boolean", "key long")


#: Characters of distinct texts for each bundle and each slice, about two million n-grams.
SLICE = 1 << 23
#: Stands for a null id in joins.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class QualitySettings:
    """Weight of the corpus share in occurrences, and the least mean log ratio."""

    prior: float = 5.0
    threshold: float = -0.25
    least_words: int = 50


def _features(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and document of every unigram and bigram of a piece."""
    owner = piece.owner()
    pairs, whole = grams_inside(piece, 2)
    return np.concatenate([mix(piece.marks), pairs[whole]]), np.concatenate([owner, owner[: len(pairs)][whole]])


def _packed(values: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all second bytes, ..., in zstd."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8").astype(np.uint64)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, equal for equal texts, and ``_id``, the id without nulls."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("_key", key).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def text_classes(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """key, n_grams, n_chars, good: each distinct text and whether a copy of it is
    trusted. ``trusted`` holds distinct ``doc_id``; it grows with the documents, so it is
    merged with them and never broadcast."""
    chosen = trusted.select(F.col("doc_id").cast("long")).distinct().withColumn("_good", F.lit(True))
    marked = rows.select("doc_id", "key", "n_grams", "word_chars").join(chosen.hint("merge"), "doc_id", "left")
    same = marked.groupBy("key").agg(
        F.max("n_grams").alias("n_grams"), F.max("word_chars").alias("n_chars"),
        F.coalesce(F.max("_good"), F.lit(False)).alias("good"),
    )
    return stage(same, "text-classes")


def _bundle(key: str, bundles: int) -> Column:
    return F.pmod(F.col(key), F.lit(bundles))


def text_bundles(docs: DataFrame, bundles: int) -> DataFrame:
    """bundle, keys, sizes, texts: texts of some rows of ``docs`` that go to one bundle,
    end to end in zstd, with their keys and bytes. Copies within a batch are left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, first = np.unique(np.array(column(batch, "_key")), return_index=True)
            bundle = np.array(column(batch, "bundle"))[first]
            order = np.argsort(bundle, kind="stable")
            key, first, bundle = key[order], first[order], bundle[order]
            data, bounds = buffers(column(batch, "text").take(pa.array(first)))
            cuts = np.flatnonzero(np.append(True, bundle[1:] != bundle[:-1])) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                texts = pa.Codec("zstd", 3).compress(np.ascontiguousarray(data[bounds[a] : bounds[b]]), asbytes=True)
                row = [bundle[a], key[a:b].tobytes(), np.diff(bounds[a : b + 1]).tobytes(), texts]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["bundle", "keys", "sizes", "texts"])

    placed = keyed(docs.select("doc_id", "text")).select("_key", _bundle("_key", bundles).alias("bundle"), "text")
    return placed.mapInArrow(pack, "bundle long, keys binary, sizes binary, texts binary")


@dataclass
class Held:
    """n-grams of the texts of a bundle: ``count`` times fingerprint ``gram`` in text
    ``doc``, and of each text its key and whether it is trusted."""

    keys: np.ndarray
    good: np.ndarray
    gram: np.ndarray
    doc: np.ndarray
    count: np.ndarray


def _held(table: pa.Table) -> Held:
    """Reads the rows of ``text_bundles`` and the trusted keys of one bundle."""
    trusted = table.column("good").drop_null().to_numpy()
    seen: set[int] = set()
    keys, found = [np.zeros(0, np.int64)], [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
    at = 0
    for row in table.filter(pc.is_valid(table.column("keys"))).select(["keys", "sizes", "texts"]).to_pylist():
        own, sizes = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["sizes"], np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        data = pa.Codec("zstd").decompress(row["texts"], int(bounds[-1])) if bounds[-1] else pa.py_buffer(b"")
        texts = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(bounds), data)
        fresh = np.array([k not in seen for k in own.tolist()], bool)
        seen.update(own.tolist())
        if not fresh.all():
            texts, own = texts.filter(pa.array(fresh)), own[fresh]
        for piece in pieces(texts):
            gram, owner = _features(piece)
            same = gram ^ mix(owner.astype(np.uint64) + np.uint64(1))
            _, first, count = np.unique(same, return_index=True, return_counts=True)
            found.append((gram[first], (at + piece.first + owner[first]).astype(np.int32), count.astype(np.int32)))
        keys.append(own)
        at += len(own)
    key = np.concatenate(keys)
    return Held(key, np.isin(key, trusted), *[np.concatenate(x) for x in zip(*found, strict=True)])


ASKED = "bundle long, part long, n long, grams binary, counts binary, goods binary"
ANSWERS = "bundle long, part long, n long, counts binary, goods binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def asked(table: pa.Table, slices: int) -> pa.Table:
    """For each slice the different n-grams of a bundle in order, as steps from one to the
    next, and how often all and the trusted texts of the bundle have them."""
    held = _held(table)
    gram, place = np.unique(held.gram, return_inverse=True)
    counts = np.bincount(place, held.count, len(gram)).astype(np.uint64)
    goods = np.bincount(place, held.count * held.good[held.doc], len(gram)).astype(np.uint64)
    part = (((gram >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(gram) else np.zeros(0, np.int64)
    bundle = table.column("bundle")[0].as_py()
    rows = [
        (bundle, part[a], b - a, _packed(np.diff(gram[a:b], prepend=np.uint64(0))), _packed(counts[a:b]), _packed(goods[a:b]))
        for a, b in zip(begins, np.append(begins[1:], len(gram)), strict=True)
    ]
    return pa.Table.from_pylist([dict(zip(_names(ASKED), r, strict=True)) for r in rows], _types(ASKED))


def answered(table: pa.Table) -> pa.Table:
    """What all bundles together have of the n-grams that each one asks for."""
    n = table.column("n").to_numpy()
    read = [
        [_unpacked(x, m) for x, m in zip(table.column(c).to_pylist(), n.tolist(), strict=True)]
        for c in ("grams", "counts", "goods")
    ]
    gram, place = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read[0]]), return_inverse=True)
    # sums of doubles are exact up to 2^53
    totals = [np.bincount(place, np.concatenate(x), len(gram)).astype(np.uint64)[place] for x in read[1:]]
    bounds = np.append(0, np.cumsum(n))
    packed = [pa.array([_packed(t[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for t in totals]
    return pa.table([*(table.column(c) for c in ("bundle", "part", "n")), *packed], names=_names(ANSWERS))


def added(table: pa.Table, answers: pa.Table, share: float, prior: float) -> pa.Table:
    """key, sum: log ratios of the n-grams of each text of a bundle, added up."""
    held = _held(table)
    answers = answers.sort_by("part")  # slices are ranges, so this is the order of the n-grams
    n = answers.column("n").to_pylist()
    none = [np.zeros(0, np.uint64)]
    counts, goods = (
        np.concatenate(none + [_unpacked(x, m) for x, m in zip(answers.column(c).to_pylist(), n, strict=True)])
        for c in ("counts", "goods")
    )
    place = np.unique(held.gram, return_inverse=True)[1]
    ratio = goods.astype(np.float64)[place]
    ratio -= held.count * held.good[held.doc]
    ratio /= share
    ratio += prior
    others = counts.astype(np.float64)[place]
    others -= held.count
    others += prior
    ratio /= others
    np.log(ratio, out=ratio)
    ratio *= held.count
    sums = np.bincount(held.doc, ratio, len(held.keys))
    has = np.bincount(held.doc, minlength=len(held.keys)) > 0
    return pa.table({"key": pa.array(held.keys[has]), "sum": pa.array(sums[has])})


def bundles_of(docs: DataFrame, same: DataFrame, bundles: int) -> DataFrame:
    """``text_bundles``, and a row with ``good`` for each trusted text of a bundle."""
    trusted = same.filter("good").select(_bundle("key", bundles).alias("bundle"), F.col("key").alias("good"))
    return text_bundles(docs, bundles).unionByName(trusted, allowMissingColumns=True)


def questions(held: DataFrame, slices: int) -> DataFrame:
    def ask(table: pa.Table) -> pa.Table:
        return asked(table, slices)

    return held.groupBy("bundle").applyInArrow(ask, ASKED)


def scores(docs: DataFrame, rows: DataFrame, labels: DataFrame, settings: QualitySettings) -> DataFrame:
    """key, sum: sum of the log ratios of each distinct text, if there is trusted text."""
    same = text_classes(rows, trusted_ids(labels))
    total = same.agg(
        F.sum("n_grams").alias("all"), F.sum(F.when(F.col("good"), F.col("n_grams"))).alias("good"), F.sum("n_chars").alias("chars")
    ).first()
    if not total.good:
        return same.select("key", F.lit(0.0).alias("sum"))
    share, prior = total.good / total["all"], settings.prior
    slices = max(1, -(-total.chars // SLICE))
    held = bundles_of(docs, same, slices)
    answers = questions(held, slices).groupBy("part").applyInArrow(answered, ANSWERS)

    def add(table: pa.Table, found: pa.Table) -> pa.Table:
        return added(table, found, share, prior)

    # Both need the same bundles, which Spark therefore deals once.
    return held.groupBy("bundle").cogroup(answers.groupBy("bundle")).applyInArrow(add, "key long, sum double")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring bounds."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(piece: Piece) -> np.ndarray:
    """Words of each document inside a three-word window that it holds twice or more."""
    windows, whole = grams_inside(piece, 3)
    owner = piece.owner()
    inside = np.flatnonzero(whole)
    keys = windows[inside] ^ mix(owner[inside].astype(np.uint64) + np.uint64(1))
    _, index, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = inside[times[index] > 1]
    covered = np.zeros(len(piece.marks), bool)
    for k in range(3):
        covered[again + k] = True
    return _sums(covered, piece.begins)


def _copied_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    copies = 0
    for line in text.split(b"\n"):
        if line in seen:
            copies += 1
        elif line.strip():
            seen.add(line)
    return copies


def _judged(batch: pa.RecordBatch, settings: QualitySettings) -> Iterator[pa.RecordBatch]:
    """Surface verdicts of a batch, piece by piece and in its order."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lead = (np.arange(256) & 0xC0) != 0x80
    lead[[9, 10, 11, 12, 13, 32]] = False
    for piece in pieces(column(batch, "text")):
        n = piece.counts
        repeated = _repeats(piece)
        failed = (n < settings.least_words) | (100 * repeated > 50 * n)
        lines = [
            _copied_lines(piece.data[a:b].tobytes())
            for a, b in zip(piece.bounds[:-1], piece.bounds[1:], strict=True)
        ]
        columns = [
            chunk(batch, "doc_id", piece).cast(pa.int64()), pa.array(n, pa.int64()),
            pa.array(_sums(lead[piece.data], piece.bounds)), pa.array(_sums(symbol[piece.data], piece.bounds)),
            pa.array(lines, pa.int64()), pa.array(repeated), pa.array(failed), pa.array(np.maximum(2 * n - 1, 0), pa.int64()),
            chunk(batch, "_key", piece),
        ]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SURFACE.split(", ")])


def surface(docs: DataFrame, settings: QualitySettings) -> DataFrame:
    """Surface verdict and ``key`` of the text of each row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _judged(batch, settings)

    return keyed(docs.select("doc_id", "text")).mapInArrow(judge, SURFACE)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that a reader marked as good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")


def verdicts(docs: DataFrame, labels: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """One verdict for each row of ``docs``."""
    settings = settings or QualitySettings()
    rows = stage(surface(docs, settings), "surface-verdicts")
    found = rows.join(stage(scores(docs, rows, labels, settings), "scores").hint("merge"), "key", "left")
    mean = F.coalesce(F.col("sum") / F.col("n_grams"), F.lit(0.0))
    scored = found.withColumn("score", F.when(F.col("n_grams") > 0, F.round(mean, 9)).otherwise(F.lit(0.0)))
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= settings.threshold))
    return scored.select(*[x.split()[0] for x in VERDICT.split(", ")])


def keep_good(docs: DataFrame, labels: DataFrame, settings: QualitySettings | None = None) -> DataFrame:
    """Rows of ``docs`` whose verdict is to stay, with all their columns."""
    settings = settings or QualitySettings()
    rows = stage(surface(docs, settings), "surface-verdicts")
    found = stage(scores(docs, rows, labels, settings), "scores")
    good = rows.filter("NOT base_failed").join(found.hint("merge"), "key").filter(F.round(F.col("sum") / F.col("n_grams"), 9) >= settings.threshold)
    stay = good.select(F.col("key").alias("_key"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_id")).distinct()
    return keyed(docs).join(stay.hint("shuffle_hash"), ["_key", "_id"], "left_semi").select(*docs.columns)

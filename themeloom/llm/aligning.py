"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Both tokenizers cut the same bytes, a space and the text. The arrays of token ends
are walked together at the current index shift. Exponential probing compares slices
of doubling length at that shift and jumps over stretches where tokens match one to
one; where they do not, the two ends advance in turn until they meet again, which is
one irregular group and a new shift. Each end that both share closes a group, and
links the token of A to the token of B that end there (no token is empty).

How many links hold an id pair is counted over the corpus. Texts are handled in parts of
bounded size: a part adds up its pairs before they are shuffled, and gets back the
counts of its own pairs only. The table of all pairs is never in one place, and a pair
that is in all parts is one narrow row for each of them.

Results for odd rows: a text that is null, empty, or that a tokenizer does not give back
byte for byte has no tokens, zero counts and an empty ``groups``; null and repeated ids
keep a row each; ties for the highest count of a B id all count as best; an empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.vocabularies import Vocabulary, VocabularyFiles, load
from themeloom.llm.words import column
from themeloom.runtime import stage

#: Bytes of text in a part; a longer document is a part of its own.
PART_BYTES = 8 << 20
#: First length that is probed at a shift.
PROBE = 4


def runs(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """Rows (a0, a1, b0, b1, one to one) of stretches that cover the tokens of both, in
    order: tokens that match one to one, or a single irregular group.

    ``a`` and ``b`` are the lengths of the tokens of the same bytes, so that from a
    shared start ends are equal as long as lengths are.
    """
    found: list[int] = []
    i, j, n = 0, 0, len(a)
    while i < n:
        a0, b0 = i, j
        left, right = a[i], b[j]
        if left == right:
            i, j, step = i + 1, j + 1, PROBE
            while i < n and a[i : i + step] == b[j : j + step]:
                i, j, step = i + step, j + step, step * 2
            while i < n and step > 1:
                step //= 2
                if a[i : i + step] == b[j : j + step]:
                    i, j = i + step, j + step
            if i > n:  # the last slices were shorter than the step
                i, j = n, j - (i - n)
            found += a0, i, b0, j, 1
            continue
        while left != right:
            if left < right:
                i += 1
                left += a[i]
            else:
                j += 1
                right += b[j]
        i, j = i + 1, j + 1
        found += a0, i, b0, j, 0
    return np.array(found, np.int64).reshape(-1, 5)


def _closing(start: np.ndarray, end: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Places of the tokens that close a group: all of a stretch, or the last of a group."""
    first = np.where(one, start, end - 1)
    count = end - first
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(first - before, count)


class Aligned:
    """One text cut by both vocabularies; without tokens if either changes its bytes.
    ``at_a`` and ``at_b`` are the places of the tokens that close each group."""

    def __init__(self, text: str | None, a: Vocabulary, b: Vocabulary) -> None:
        self.a_ids = self.b_ids = self.at_a = self.at_b = np.zeros(0, np.int64)
        if not text or (b_ids := b.cut(text)) is None or (a_ids := a.cut(text)) is None:
            return
        self.a_ids, self.b_ids = a_ids, b_ids
        found = runs(a.lengths(self.a_ids), b.lengths(self.b_ids))
        one = found[:, 4] == 1
        self.at_a = _closing(found[:, 0], found[:, 1], one)
        self.at_b = _closing(found[:, 2], found[:, 3], one)

    def spelled(self, a: Vocabulary, b: Vocabulary) -> str:
        """Ids of the groups as ``a1,a2|b1;a3|b2,b3``: each id with the mark behind it,
        put where it belongs."""
        if not len(self.at_a):
            return ""
        parts = np.empty(len(self.a_ids) + len(self.b_ids), object)
        for ids, at, other, names, mark in (
            (self.a_ids, self.at_a, np.concatenate([[-1], self.at_b[:-1]]), a.names, "|"),
            (self.b_ids, self.at_b, self.at_a, b.names, ";"),
        ):
            # Tokens of the other text that stand in front of those of each group.
            place = np.arange(len(ids)) + np.repeat(other + 1, np.diff(at, prepend=-1))
            parts[place] = names[","][ids]
            parts[place[at]] = names[mark][ids[at]]
        return "".join(parts.tolist())[:-1]


def aligned(docs: DataFrame, files: VocabularyFiles = VocabularyFiles()) -> DataFrame:
    """doc_id, the ids of both tokenizers, and for each group the number of tokens of A
    and B up to its end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(files)
        for batch in batches:
            made = [Aligned(text, a, b) for text in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array([x.a_ids for x in made], pa.list_(pa.int32())),
                    pa.array([x.b_ids for x in made], pa.list_(pa.int32())),
                    pa.array([x.at_a + 1 for x in made], pa.list_(pa.int64())),
                    pa.array([x.at_b + 1 for x in made], pa.list_(pa.int64())),
                ],
                ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<long>, b_cuts array<long>"
    )


LINKED = "part long, total boolean, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_FIELDS = [(x.split()[0], _KINDS[x.split()[1]]) for x in LINKED.split(", ")]


def linked(docs: DataFrame, files: VocabularyFiles = VocabularyFiles(), part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document with its distinct id pairs and how often it links them,
    and a ``total`` row for each part with the same over its documents; written once.

    A pair is one number, the id of A times the size of B's vocabulary plus the id of B.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(files)
        part, filled = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            pairs = np.concatenate([r[7] for r in rows] or [np.zeros(0, np.int64)])
            times = np.concatenate([r[8] for r in rows] or [np.zeros(0, np.int64)])
            found, at = np.unique(pairs, return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, at, times)
            rows.append((part, True, None, 0, 0, 0, "", found, sums))
            cells = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]
            return pa.RecordBatch.from_arrays(cells, [name for name, _ in _FIELDS])

        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                made = Aligned(text, a, b)
                codes = made.a_ids[made.at_a] * len(b.tokens) + made.b_ids[made.at_b]
                pairs, times = np.unique(codes, return_counts=True)
                digest = hashlib.sha256(made.spelled(a, b).encode()).hexdigest() if len(codes) else ""
                rows.append((
                    part, False, ids[row].as_py(), len(made.a_ids), len(made.b_ids), len(codes), digest, pairs, times,
                ))
                filled += len(text or "")
                if filled >= part_bytes:
                    yield close()
                    rows, filled, part = [], 0, part + 1
        if rows:
            yield close()

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(link, LINKED), "token-links")


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, n_pair, best for each id pair of the corpus: in how many links it is, and
    whether no other A id has more with its B id."""
    each = links.filter("total").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = stage(
        each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n_pair"))
        .withColumn("b_id", F.col("pair") % b_size),
        "pair-counts",
    )
    most = counts.groupBy("b_id").agg(F.max("n_pair").alias("most"))
    return counts.join(most, "b_id").select("pair", "n_pair", (F.col("n_pair") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment(docs: DataFrame, files: VocabularyFiles = VocabularyFiles(), part_bytes: int = PART_BYTES) -> DataFrame:
    """Every document with its groups and how its links stand in the corpus."""
    links = linked(docs, files, part_bytes)
    b_size = load(files)[1].sizes.size
    asked = links.filter("total").select("part", F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(links, b_size), "pair").toDF("pair", "part", "n_pair", "best")

    def judge(texts: pa.Table, known: pa.Table) -> pa.Table:
        texts, known = texts.combine_chunks(), known.combine_chunks().sort_by("pair")
        pairs, counts, best = (known[c].to_numpy() for c in ("pair", "n_pair", "best"))
        found, times = texts["pairs"].combine_chunks(), texts["times"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(pairs, found.flatten().to_numpy())
        bounds = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[at], times * counts[at])]
        n_best, total = (pa.array(np.diff(x[bounds]), pa.int64()) for x in sums)
        own = [texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
        return pa.table([*own, n_best, total, texts["groups_sha256"]], [x.split()[0] for x in RESULT.split(", ")])

    texts = links.filter(~F.col("total")).drop("total")
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(judge, RESULT)

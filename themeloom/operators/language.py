"""Language identification with naive Bayes over character trigrams.

Training is one distributed count per language; scoring is a map over rows
without a join or shuffle. The model holds n_features numbers per language.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, NGram, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters that are held at once, and characters of text after which a piece ends.
CELLS = 1 << 20
CHARS = 1 << 18


def trigrams(df: DataFrame, text_col: str) -> DataFrame:
    """(key columns of ``df``, gram, n): counts of the letter trigrams of each text.

    The texts are dealt by their keys, so their trigrams are counted where they are taken
    and those of one text lie together.
    """
    keys = [c for c in df.columns if c != text_col]
    df = df.repartition(*keys)
    plain = F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", "_")
    chars = F.filter(F.split(F.concat(F.lit("_"), plain, F.lit("_")), ""), lambda c: c != "")
    grams = NGram(n=3, inputCol="_chars", outputCol="_grams").transform(df.withColumn("_chars", chars))
    return grams.select(*keys, F.explode("_grams").alias("gram")).groupBy(*keys, "gram").agg(F.count("*").alias("n"))


def profiles(grams: DataFrame, label_col: str = "lang") -> DataFrame:
    """(lang, gram, lp): log probability of each trigram in each language, with one
    added to every count; trained by grouping all labelled texts."""
    counts = grams.filter(F.col(label_col).isNotNull()).groupBy(label_col, "gram").agg(F.sum("n").alias("c"))
    totals = counts.groupBy(label_col).agg(F.sum("c").alias("total"))
    known = counts.select("gram").distinct()
    size = known.agg(F.count("*").alias("v")).scalar()
    every = known.join(totals, F.lit(True)).join(counts, [label_col, "gram"], "left")
    chance = (F.coalesce("c", F.lit(0)) + 1.0) / (F.col("total") + size)
    return every.select(F.col(label_col).alias("profile"), "gram", F.log(chance).alias("lp"))


def by_profile(grams: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """(key, lang): the language with the largest log likelihood; equal ones go to the
    first name. Texts without a known trigram are absent."""
    scores = grams.join(profile, "gram").groupBy(key, "profile").agg(F.sum(F.col("n") * F.col("lp")).alias("score"))
    best = F.max_by("profile", F.struct("score", F.reverse("profile")))
    return scores.groupBy(key).agg(best.alias("lang"))


def _murmur(data: bytes, seed: int = 42) -> int:
    """The hash of Spark's ``HashingTF``: 32-bit murmur3."""
    mask, h = 0xFFFFFFFF, seed
    whole = len(data) // 4 * 4
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & mask
        h ^= (k << 15 | k >> 17) * 0x1B873593 & mask
        if at < whole:
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def _place(gram: tuple[int, int, int], n_features: int) -> int:
    """Feature of three characters with spaces between them."""
    value = _murmur(" ".join(map(chr, gram)).encode())
    return (value - (value >> 31 << 32)) % n_features


def _features(text: Column, n_features: int) -> Column:
    """Sparse counts of the hashed trigrams of the letters of a text: what NGram and
    HashingTF make of its characters. Trigrams are numbered in numpy, and each different
    one is hashed once a task. Null for a null text."""
    plain = F.concat(F.lit("_"), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "_"), F.lit("_"))

    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[tuple[int, int, int], int] = {}
        rows_at_once = max(1, CELLS // n_features)

        def piece(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Distinct features of each text: how many, which and how often."""
            coded = [b"" if t is None else t.encode("utf-32-le") for t in texts]
            chars = np.frombuffer(b"".join(coded), "<u4")
            sizes = np.array([len(c) // 4 for c in coded])
            owner = np.repeat(np.arange(len(texts)), sizes)
            alphabet = np.flatnonzero(np.bincount(chars))
            code = np.zeros(int(chars.max(initial=0)) + 1, np.int64)
            code[alphabet] = np.arange(len(alphabet))
            letter, width = code[chars], len(alphabet)
            inside = np.flatnonzero(owner[2:] == owner[:-2])
            gram = ((letter[:-2] * width + letter[1:-1]) * width + letter[2:])[inside]
            if width**3 <= CELLS:
                different = np.flatnonzero(np.bincount(gram, minlength=width**3))
                table = np.zeros(width**3, np.int64)
            else:
                different, gram = np.unique(gram, return_inverse=True)
                table = np.zeros(len(different), np.int64)
            triples = alphabet[np.stack([different // width**2, different // width % width, different % width], axis=1)]
            found = []
            for triple in map(tuple, triples.tolist()):
                if triple not in known:
                    known[triple] = _place(triple, n_features)
                found.append(known[triple])
            table[different if width**3 <= CELLS else slice(None)] = found
            keys = owner[inside] * n_features + table[gram]
            counts = np.bincount(keys, minlength=len(texts) * n_features)
            cell = np.flatnonzero(counts)
            return np.bincount(cell // n_features, minlength=len(texts)), cell % n_features, counts[cell]

        for array in arrays:
            texts, done = array.to_pylist(), []
            for start in range(0, len(texts), rows_at_once):
                part = texts[start : start + rows_at_once]
                cuts = np.cumsum([len(t or "") for t in part]) // CHARS
                for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(cuts)) + 1):
                    done.append(piece(part[at[0] : at[-1] + 1]))
            n, which, often = (np.concatenate(x) if done else np.empty(0, np.int64) for x in (zip(*done) if done else [()] * 3))
            bounds = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(len(texts)), pa.int8()), pa.array(np.full(len(texts), n_features), pa.int32()),
                    pa.ListArray.from_arrays(bounds, pa.array(which, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(often, pa.float64())),
                ],
                ["type", "size", "indices", "values"], mask=pa.array([t is None for t in texts], pa.bool_()),
            )

    # Declared so that no filter on the language takes a copy of the whole chain along.
    return F.arrow_udf(count, VectorUDT()).asNondeterministic()(plain)


def _with_features(df: DataFrame, text_col: str, n_features: int) -> DataFrame:
    return df.withColumn("_tf", _features(F.col(text_col), n_features))


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", n_features: int = 1 << 14) -> PipelineModel:
    stages = [
        StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"),
        NaiveBayes(featuresCol="_tf", labelCol="_label", predictionCol="_pred"),
    ]
    known = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    return Pipeline(stages=stages).fit(_with_features(known, text_col, n_features))


def add_language(df: DataFrame, model: PipelineModel, text_col: str = "text_clean") -> DataFrame:
    """Adds ``lang``; null where the text has no letters to decide on."""
    labels, bayes = model.stages[0].labels, model.stages[-1]
    out = bayes.transform(_with_features(df, text_col, bayes.numFeatures))
    out = IndexToString(inputCol="_pred", outputCol="_lang", labels=labels).transform(out)
    decided = F.when(F.col(text_col).rlike(r"\p{L}{2}"), F.col("_lang"))
    return out.withColumn("lang", decided).select(*[c for c in df.columns if c != "lang"], "lang")

"""Order MinHash fingerprints of whole texts (DataFrame functions only).

A text is read as words, and as single letters where a script has no spaces. Its k-mers
are the runs of k words, each numbered by how often it came before. A hash of (k-mer,
number) puts every one on a ring of 2^36 places. For each of m evenly spaced points the l
k-mers that follow on the ring are selected; each point so has its own random order of
the k-mers, the same one for all texts. The l selected k-mers are put
back in text order and hashed as a tuple, and the m tuple hashes are the fingerprint. Two texts agree at a point when they share the selected k-mers and have
them in the same order, so the share of equal tuples falls with edit distance, also
where a text is only rearranged.

On the ring one sorted array serves all m points: only the first l k-mers behind each
point matter, and a point without one before the next point takes that point's tuple.
All work is linear in the length of a text but for two sorts of longs.

Results for odd rows: a null text is empty; texts without words share the fingerprint of
no k-mers; a text of fewer than k words is one k-mer; fewer than l k-mers make shorter
tuples. Texts are ordered by falling id, null ids last, and by a
hash of the text where ids repeat; rows that repeat id and text are one place in that
order and have the same result, each a row. A table of one document has itself as its
next. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.ranking import spread_row_number
from themeloom.runtime import stage

# Letters of scripts written without spaces (Thai, kana, ideographs; three
# bytes each in UTF-8), a word of their own, and the longest run of others that is one word.
ALONE = r"\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF"
LONGEST = 32
WORD = rf"[{ALONE}]|[^{ALONE}]{{1,{LONGEST}}}"
#: Bits of the place of a k-mer in a text (longer strings do not fit into a row).
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1


@dataclass(frozen=True)
class OrderMinHash:
    """k words a k-mer, tuples of l k-mers, 2^point_bits points on the ring."""

    k: int = 5
    l: int = 2
    point_bits: int = 6

    @property
    def points(self) -> int:
        return 1 << self.point_bits


def _top(value: Column) -> Column:
    """The hash of a value whose low bits are a place."""
    return F.shiftrightunsigned(value, PLACE_BITS)


def _with_place(value: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text. Few words are long or in a script without spaces,
    and only those are looked at letter by letter."""
    runs = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    odd = lambda w: (F.length(w) > LONGEST) | (F.octet_length(w) > 2 * F.length(w))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    cut = F.flatten(F.transform(runs, lambda w: F.when(odd(w), F.regexp_extract_all(w, F.lit(WORD), 0)).otherwise(F.array(w))))
    return F.when(F.exists(runs, odd), hashed(cut)).otherwise(hashed(runs))


def kmer_hashes(words: Column, k: int) -> Column:
    """Hash of the k words that start at each place, by the hashes of the words; of all
    words if there are fewer."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - k + 1, F.lit(1)))
    return F.transform(starts, lambda v, i: F.xxhash64(v, *[F.get(words, i + j) for j in range(1, k)]))


def with_signature(rows: DataFrame, text: str, name: str, by: OrderMinHash = OrderMinHash()) -> DataFrame:
    """``rows`` with the m tuple hashes of a string column as ``array<int>``."""
    held, l = rows.columns, by.l
    step = rows.withColumn("_h", word_hashes(F.col(text)))
    step = step.withColumn("_h", kmer_hashes(F.col("_h"), by.k))
    step = step.withColumn("_h", F.sort_array(F.transform("_h", _with_place)))
    # Equal k-mers are neighbours now, in text order: their runs give the numbers.
    h = F.col("_h")
    apart = lambda v, other, bits: F.coalesce(F.shiftrightunsigned(v.bitwiseXOR(other), bits) != 0, F.lit(True))
    new_run = lambda v, i: F.when(apart(v, F.get(h, i - 1), PLACE_BITS), i)
    step = step.withColumn("_r", F.array_compact(F.transform("_h", new_run)))
    ends = lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get(F.col("_r"), j + 1), F.size(h)) - s - 1)
    step = step.withColumn("_r", F.flatten(F.transform("_r", ends)))
    ring = F.zip_with("_h", "_r", lambda v, nth: _with_place(F.xxhash64(_top(v), nth), v.bitwiseAND(F.lit(PLACES).cast("long"))))
    step = step.withColumn("_h", F.sort_array(ring)).drop("_r")
    # Of the k-mers between two points only the first l can be selected.
    step = step.withColumn("_h", F.filter("_h", lambda v, i: apart(v, F.get(h, i - l), 64 - by.point_bits)))
    point = lambda v: F.shiftright(v, 64 - by.point_bits).cast("int") + by.points // 2

    def selected(i: Column) -> Column:
        at = [F.get(F.col("_h"), (i + j) % F.size("_h")) for j in range(l)]
        kmers = F.array_distinct(F.array(*[F.struct(v.bitwiseAND(F.lit(PLACES).cast("long")).alias("p"), _top(v).alias("h")) for v in at]))
        return F.shiftright(F.xxhash64(F.transform(F.array_sort(kmers), lambda x: x["h"])), 32).cast("int")

    def filled(v: Column, i: Column) -> Column:
        here = point(v) - F.coalesce(point(F.get(F.col("_h"), i - 1)), F.lit(-1))
        return F.when(here > 0, F.array_repeat(selected(i), here)).otherwise(F.array().cast("array<int>"))

    rest = F.array_repeat(selected(F.lit(0)), by.points - 1 - point(F.element_at("_h", -1)))
    tuples = F.concat(F.flatten(F.transform("_h", filled)), rest)
    none = F.array_repeat(F.lit(0), by.points)
    return step.select(*held, F.when(F.size("_h") == 0, none).otherwise(tuples).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of the points at which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def spelled(signature: Column) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each point."""
    digits = F.transform(signature, lambda v: F.lpad(F.lower(F.hex(F.lit(0xFFFFFFFF).cast("long").bitwiseAND(v.cast("long")))), 8, "0"))
    return F.array_join(digits, "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (number, tie) that rows share only if they repeat both."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("number"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("tie"),
    )


def signatures(docs: DataFrame, by: OrderMinHash = OrderMinHash()) -> DataFrame:
    """doc_id, number, tie, n_chars, signature of every row; written once."""
    signed = with_signature(_keyed(docs), "text", "signature", by)
    return stage(
        signed.select("doc_id", "number", "tie", F.length("text").cast("long").alias("n_chars"), "signature"),
        "signatures",
    )


def neighbours(signed: DataFrame) -> DataFrame:
    """(number, tie) of each place in the order, with the key of the place that it follows
    (``to_number``, ``to_tie``), half the characters there, and its own copies."""
    places = signed.groupBy("doc_id", "number", "tie").agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    ordered = stage(spread_row_number(places, [], [F.desc_nulls_last("doc_id"), F.asc("tie")], "r", "long"), "places")
    n = max(ordered.count(), 1)
    before = ordered.select(
        (F.col("r") % n + 1).alias("r"), F.col("number").alias("to_number"), F.col("tie").alias("to_tie"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("half"),
    )
    return stage(ordered.select("r", "number", "tie", "copies").join(before, "r").drop("r"), "neighbours")


def fingerprints(docs: DataFrame, by: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Every row of ``docs`` with its fingerprint, that of its edited text (its last half
    replaced by the start of the next text), and how alike they and the next are.

    Texts move once by their own key, and the start of each once to the text before it.
    """
    signed = signatures(docs, by)
    follow = neighbours(signed)
    repeats = not follow.filter("copies > 1").isEmpty()
    once = signed.select("doc_id", "number", "tie", "signature")
    if repeats:
        once = once.groupBy("number", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    # Both uses of the texts read one exchange of these three columns.
    whole = _keyed(docs).select("number", "tie", "text").join(once, ["number", "tie"])
    key = [F.col("to_number").alias("number"), F.col("to_tie").alias("tie")]
    heads = whole.join(follow, ["number", "tie"]).select(
        *key, F.left("text", F.col("half")).alias("head"), F.col("signature").alias("next_signature"), "half", "copies"
    )
    if repeats:
        repeated = heads.filter("copies > 1").groupBy("number", "tie").agg(
            *[F.first(c).alias(c) for c in ("head", "next_signature", "half", "copies")]
        )
        heads = heads.filter("copies = 1").unionByName(repeated)
    kept = F.left("text", (F.length("text") - F.col("half")).cast("int"))
    both = whole.join(heads, ["number", "tie"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.concat(kept, "head").alias("edited"), "signature",
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
    return with_signature(both, "edited", "edited_signature", by).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("signature")).alias("fingerprint"),
        spelled(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), "near_next",
    )

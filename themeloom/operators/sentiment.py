"""Lexicon sentiment in [-1, 1] (Hutto & Gilbert 2014) as a Spark job.

Tokens with their three predecessors are exploded, joined to the caller's
lexicon and summed per item. Lexicon and phrases are written first, so that Spark knows
their size: only then are they broadcast and stay the words where they are. Only lexicon
words survive the join and they are summed on the map side, so the shuffle carries about
one narrow row per item.

Phrases (idioms and other fixed expressions) are found by a join of the word n-grams of
an item with the caller's phrase table. At each place the longest phrase counts; its
words become one token with the valence of the phrase, and the words around it act on
it as on any other. Emoji are spelled out by the caller's table of names before cleaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.runtime import stage

# Fixed values of the method.
NEGATION_FACTOR = -0.74
BOOST = 0.293
CAPS = 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION = 0.292
QUESTION, QUESTION_MAX = 0.18, 0.96
ALPHA = 15.0
FADE = (1.0, 0.95, 0.9)
# "least" turns the next word round, but "at least" and "very least" do not.
LEAST, LEAST_AFTER = "least", ["at", "very"]

# Fixed word lists.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "none", "nope",
    "nor", "not", "nothing", "nowhere", "oughtnt", "rarely", "seldom", "shant", "shouldnt",
    "wasnt", "werent", "without", "wont", "wouldnt",
]
AMPLIFIERS = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "enormously", "entirely", "especially", "exceptionally", "extremely", "fully", "greatly",
    "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most", "particularly",
    "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally",
    "tremendously", "unbelievably", "unusually", "utterly", "very",
]
DAMPENERS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta",
]


EDGES = r"(?<=^| )[^\p{L}\p{N} ]+|[^\p{L}\p{N} ]+(?= |$)"


def bare_words(text: Column) -> Column:
    """Words without leading and trailing punctuation, parted by one blank.

    ``text`` is cleaned, so blanks are its only white space; working on the whole
    string is one regex pass instead of one per word.
    """
    return F.trim(F.regexp_replace(F.regexp_replace(text, EDGES, ""), " +", " "))


def _shout(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def name_emoji(df: DataFrame, emoji: DataFrame, text_col: str = "text") -> DataFrame:
    """Writes the names of emoji into ``text_col``: ``emoji`` is (emoji, name), one
    character each, and bounded like any symbol table."""
    known = emoji.agg(F.map_from_entries(F.collect_list(F.struct("emoji", "name"))).alias("names"))
    symbol = F.split(F.col(text_col), "")
    named = F.transform(symbol, lambda c: F.coalesce(F.concat(F.lit(" "), F.col("_names")[c], F.lit(" ")), c))
    # Only texts with a character outside the basic plane or a symbol are taken apart.
    odd = F.col(text_col).rlike(r"[\x{10000}-\x{10FFFF}\x{2190}-\x{2BFF}\x{FE0F}]")
    joined = df.withColumn("_names", known.select("names").scalar())
    return joined.withColumn(text_col, F.when(odd, F.array_join(named, "")).otherwise(F.col(text_col))).drop("_names")


def phrase_spans(items: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """(key, spans): for items (key, low) with phrases, the (at, n) of those that count:
    from the left, the longest at each place, none inside another."""
    # Lengths of fixed expressions are few.
    phrases = stage(phrases.select("phrase"), "phrases")
    lengths = sorted(r.n for r in phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
    none = F.array().cast("array<struct<at:int,n:int,phrase:string>>")

    def grams(n: int) -> Column:
        gram = lambda i: F.struct(
            i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("low", i + 1, n), " ").alias("phrase")
        )
        return F.when(F.size("low") >= n, F.transform(F.sequence(F.lit(0), F.size("low") - n), gram)).otherwise(none)

    found = items.select(key, F.inline(F.concat(none, *[grams(n) for n in lengths]))).join(phrases, "phrase", "left_semi")
    spans = found.groupBy(key).agg(F.collect_list(F.struct("at", (-F.col("n")).alias("less"))).alias("s"))  # at most the item's words
    ends = lambda kept: F.coalesce(F.element_at(kept, -1)["at"] + F.element_at(kept, -1)["n"], F.lit(0))
    start = F.array().cast("array<struct<at:int,n:int>>")
    chosen = F.aggregate(F.array_sort("s"), start, lambda kept, x: F.when(
        x["at"] >= F.when(F.size(kept) > 0, ends(kept)).otherwise(0),
        F.concat(kept, F.array(F.struct(x["at"].alias("at"), (-x["less"]).alias("n")))),
    ).otherwise(kept))
    return spans.select(key, chosen.alias("spans"))


def _joined(words: str) -> Column:
    """The array ``words`` with the words of each span as one."""
    span = lambda s, j: F.concat(
        F.slice(words, F.coalesce(F.get("spans", j - 1)["at"] + F.get("spans", j - 1)["n"], F.lit(0)) + 1,
                s["at"] - F.coalesce(F.get("spans", j - 1)["at"] + F.get("spans", j - 1)["n"], F.lit(0))),
        F.array(F.array_join(F.slice(words, s["at"] + 1, s["n"]), " ")),
    )
    last = F.element_at("spans", -1)["at"] + F.element_at("spans", -1)["n"]
    whole = F.concat(F.flatten(F.transform("spans", span)), F.slice(words, last + 1, F.size(words) - last))
    return F.when(F.col("spans").isNull(), F.col(words)).otherwise(whole)


def score_tokens(
    df: DataFrame, lexicon: DataFrame, text_col: str = "text_clean", key: str = "id", phrases: DataFrame | None = None
) -> DataFrame:
    """(key, sentiment): one row per item that holds a lexicon word or a phrase.

    ``phrases`` is (phrase, valence): lower-case words without apostrophes, parted by a
    blank.

    ``lexicon`` is (word, valence). The planner broadcasts it only when its
    measured size is below the session's threshold; otherwise the exploded
    words are shuffled with adaptive skew handling.
    """
    text = F.col(text_col)
    low = F.split(F.replace(F.lower("bare"), F.lit("'"), F.lit("")), " ")
    items = df.select(key, text_col)
    if phrases is not None:
        # The texts move to their spans, not the words taken from them.
        bare = items.select(key, bare_words(text).alias("bare"))
        items = items.join(phrase_spans(bare.select(key, low.alias("low")), phrases, key), key, "left")
    base = (
        items.select(
            F.col(key), bare_words(text).alias("bare"),
            F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(4)).alias("bangs"),
            (F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))).alias("asks"),
            *(["spans"] if phrases is not None else []),
        )
        .withColumn("toks", F.split("bare", " "))
        .withColumn("low", low)
    )
    if phrases is not None:
        base = base.withColumns({"toks": _joined("toks"), "low": _joined("low")})
        lexicon = lexicon.select("word", "valence").unionByName(phrases.select(F.col("phrase").alias("word"), "valence"))
    base = (
        base.withColumn("but_at", F.array_position("low", F.lit("but")))
        # A capital word stands out only among words that are not capital.
        .withColumn("mixed", F.exists("toks", lambda w: ~_shout(w)))
    )
    # Each word takes its context along before the explode: exploding next to the
    # whole word list would copy the list once per word.
    context = F.transform(
        "low",
        lambda w, i: F.struct(
            w.alias("word"), i.alias("i"),
            *[F.get("low", i - d).alias(f"p{d}") for d in (1, 2, 3)],
            F.get("toks", i).alias("as_written"),
        ),
    )
    lexicon = stage(lexicon.select("word", F.col("valence").cast("double").alias("v")), "lexicon")
    hits = (
        base.select(key, "bangs", "asks", "but_at", "mixed", F.inline(context))
        .join(lexicon, "word")
    )
    sign = F.signum("v")
    value = F.col("v") + F.when(F.col("mixed") & _shout(F.col("as_written")), sign * CAPS).otherwise(0.0)
    for d, fade in zip((1, 2, 3), FADE):
        p = F.col(f"p{d}")
        boost = F.when(p.isin(AMPLIFIERS), BOOST).when(p.isin(DAMPENERS), -BOOST).otherwise(0.0)
        value = value + sign * boost * fade
    for d in (1, 2, 3):
        value = value * F.when(F.col(f"p{d}").isin(NEGATIONS), NEGATION_FACTOR).otherwise(1.0)
    turned = (F.col("p1") == LEAST) & ~F.coalesce(F.col("p2"), F.lit("")).isin(LEAST_AFTER)
    value = value * F.when(turned, NEGATION_FACTOR).otherwise(1.0)
    place = F.col("i") + 1
    value = value * (
        F.when((F.col("but_at") > 0) & (place < F.col("but_at")), BEFORE_BUT)
        .when((F.col("but_at") > 0) & (place > F.col("but_at")), AFTER_BUT)
        .otherwise(1.0)
    )
    sums = hits.groupBy(key).agg(
        F.sum(value).alias("s"), F.max("bangs").alias("bangs"), F.max("asks").alias("asks")
    )
    emphasis = F.col("bangs") * EXCLAMATION + F.when(F.col("asks") > 3, QUESTION_MAX).when(
        F.col("asks") > 1, F.col("asks") * QUESTION
    ).otherwise(0.0)
    total = F.col("s") + F.signum("s") * emphasis
    compound = total / F.sqrt(total * total + ALPHA)
    return sums.select(key, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound)), 4).alias("sentiment"))


def add_sentiment(
    df: DataFrame, lexicon: DataFrame, text_col: str = "text_clean", key: str = "id", phrases: DataFrame | None = None
) -> DataFrame:
    """Adds ``sentiment``; an item without lexicon words scores 0."""
    scores = score_tokens(df, lexicon, text_col, key, phrases)
    return df.join(scores, key, "left").withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))

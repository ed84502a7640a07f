"""Phrases, "least" and emoji names in the lexicon sentiment."""

import math

from themeloom.operators import sentiment


def scores(spark, texts, words, phrases=None):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text_clean string")
    lexicon = spark.createDataFrame(words, "word string, valence double")
    table = None if phrases is None else spark.createDataFrame(phrases, "phrase string, valence double")
    rows = sentiment.add_sentiment(df, lexicon, phrases=table).collect()
    return [r.sentiment for r in sorted(rows, key=lambda r: int(r.id))]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


def test_phrases_count_once_and_the_longest_wins(spark):
    words = [("bad", -2.5), ("kiss", 2.0), ("death", -2.9)]
    phrases = [("kiss of death", -1.5), ("of death", -3.0), ("bad ass", 1.5), ("bad ass kiss", 1.9), ("cant stand", -2.0)]
    got = scores(spark, [
        "the kiss of death came", "of death and kiss", "a bad ass car", "a bad ass kiss of death", "bad ass. Kiss!",
        "not the kiss of death", "I can't stand it", "very bad ass", "KISS OF DEATH here", "nothing to see", "",
        "bad ass bad ass",
    ], words, phrases)
    assert got == [
        compound(-1.5), compound(-3.0 + 2.0), compound(1.5), compound(1.9 - 3.0), compound(1.9 + 0.292),
        compound(-1.5 * -0.74), compound(-2.0), compound(1.5 + 0.293), compound(-1.5 - 0.733), 0.0, 0.0,
        # the first "bad ass" precedes the second, which has no booster in front of it
        compound(3.0),
    ]


def test_without_phrases_words_count_alone(spark):
    assert scores(spark, ["a kiss of death"], [("kiss", 2.0), ("death", -2.9)], []) == [compound(-0.9)]


def test_least_turns_the_next_word_round(spark):
    got = scores(
        spark, ["the least good", "least good", "at least good", "the very least good", "good at least"], [("good", 1.9)]
    )
    assert got == [compound(1.9 * -0.74), compound(1.9 * -0.74), compound(1.9), compound(1.9 + 0.95 * 0.293), compound(1.9)]


def test_emoji_are_spelled_out(spark):
    df = spark.createDataFrame([(1, "so \U0001F600!"), (2, "no emoji"), (3, None), (4, "\u2764\ufe0f\U0001F9FF")], "id int, text string")
    emoji = spark.createDataFrame([("\U0001F600", "grinning face"), ("\u2764", "red heart")], "emoji string, name string")
    rows = {r.id: r.text for r in sentiment.name_emoji(df, emoji).collect()}
    assert rows[1].split() == ["so", "grinning", "face", "!"] and rows[2] == "no emoji" and rows[3] is None
    assert rows[4].startswith(" red heart ")


def test_words_are_not_shuffled_to_a_small_lexicon(spark):
    df = spark.createDataFrame([("1", "a kiss of death"), ("1", "bad ass"), (None, "a kiss")], "id string, text_clean string")
    lexicon = spark.createDataFrame([("kiss", 2.0), ("death", -2.9)], "word string, valence double")
    phrases = spark.createDataFrame([("bad ass", 1.5)], "phrase string, valence double")
    scored = sentiment.score_tokens(df, lexicon, phrases=phrases)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # The join of a text with its spans may move texts; words and word n-grams stay where they are.
    assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") <= 1
    assert {r.id for r in scored.collect()} == {"1", None}

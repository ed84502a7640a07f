"""Quotation linking in conversations, and reply order without quotes.

Each line of a message has a quote level: the number of ``>`` marks in front of it.
Neighbouring lines of one level are a passage; lines are normalised (lower case, one
space between words) and hashed, and so is the passage as a whole. What a message says
itself (level 0, without the line that announces a quote) gives an original for each of
its lines, its paragraphs and the whole.

Each line of a quoted passage has at most two candidates: the latest earlier turn of its
own conversation that says it, and the first message of another conversation that does;
the passage as a whole has the same. The passage is linked to the message that most of
its lines point to (the whole counts as all lines), so a quote of some lines of a
message is linked too; of equal ones the own conversation comes first, there the latest
turn, elsewhere the smallest (conversation, turn). The message replied to is the one of
its first linked passage of level 1 (then of deeper levels), or else the turn before.
Reply order puts a message behind the one it replies to.

No line is joined with all messages that say it: earlier turns are found by a running
maximum over slices, and other conversations by one row for each hash. Places in
conversations come from slices too, so a conversation may be of any size.

Results for odd rows: a null text is empty; empty messages have no passages; rows that
repeat a conversation and turn are placed by a hash of their texts, each with its own
quotes and links, and rows that repeat the text too share one result; a link to a turn
that is repeated stands for the first row of it; rows with a null conversation or turn are
kept, linked to nothing, with no reply; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.operators.ranking import spread_max_before, spread_row_number
from themeloom.runtime import stage

#: Marks of quote levels in front of a line.
MARKS = r"^((?:[ \t]*>)+)"
# Ends of lines that announce a quote, in four languages.
ANNOUNCES = r"(?iu)(wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)\s*:\s*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(text: Column) -> Column:
    return F.xxhash64(_normal(text))


def lines_of(text: Column) -> Column:
    """Array of (level, said) for the lines of a text."""
    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(line, MARKS, "")).alias("said"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), parse)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _own(lines: Column) -> Column:
    """Lines of level 0 but those that announce a quote, joined."""

    def stays(line: Column, i: Column) -> Column:
        one, two = F.get(lines, i + 1), F.get(lines, i + 2)
        quoted = F.coalesce((one["level"] > 0) | ((one["said"] == "") & (two["level"] > 0)), F.lit(False))
        return (line["level"] == 0) & ~(quoted & line["said"].rlike(ANNOUNCES))

    return F.trim(F.array_join(F.transform(F.filter(lines, stays), lambda x: x["said"]), "\n"))


def _passages(kept: Column) -> Column:
    """Array of (level, at, lines, whole) of the quoted passages, from lines that are not blank."""

    def starts(i: Column) -> Column:
        return (i == 0) | (F.get(kept, i)["level"] != F.get(kept, i - 1)["level"])

    def cut(said: Column, first: Column) -> Column:
        def passage(start: Column, at: Column) -> Column:
            part = F.slice(said, start + 1, F.coalesce(F.get(first, at + 1), F.size(said)) - start)
            return F.struct(
                F.get(kept, start)["level"].alias("level"), at.alias("at"),
                F.transform(part, lambda x: F.xxhash64(x)).alias("lines"), F.xxhash64(F.array_join(part, " ")).alias("whole"),
            )

        return F.filter(F.transform(first, passage), lambda p: p["level"] > 0)

    said, places = F.transform(kept, lambda x: _normal(x["said"])), F.sequence(F.lit(0), F.size(kept) - 1)
    return F.when(F.size(kept) > 0, _let(said, lambda x: _let(F.filter(places, starts), lambda first: cut(x, first))))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, h, role, own text without quotes, and quoted passages (level, at,
    lines, whole) of each message; ``h`` tells rows that repeat a turn apart."""
    text = F.coalesce("text", F.lit(""))

    def parts(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: x["said"] != "")
        quoted = F.exists(lines, lambda x: x["level"] > 0)
        return F.struct(
            _own(lines).alias("own_text"), F.when(quoted, _let(kept, _passages)).alias("quotes"),
            F.array_max(F.transform(lines, lambda x: x["level"])).alias("max_level"),
        )

    rows = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(text).alias("h"),
        F.col("role").cast("string"), _let(lines_of(text), parts).alias("_p"),
    )
    return rows.select("conv_id", "turn", "h", "role", "_p.own_text", "_p.quotes", "_p.max_level")


def originals(rows: DataFrame) -> DataFrame:
    """hash, conv_id, turn: whole texts, paragraphs and lines that messages say themselves."""
    parts = F.concat(F.array("own_text"), F.split("own_text", r"\n\s*\n"), F.split("own_text", "\n"))
    said = F.filter(F.transform(parts, _normal), lambda p: p != "")
    return rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", F.explode(F.array_distinct(F.transform(said, lambda p: F.xxhash64(p)))).alias("hash")
    )


LINKS = "conv_id long, turn long, h long, level int, at int, to_conv long, to_turn long"


def linked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, h, level, at, to_conv, to_turn of every quoted passage with an original."""
    passage = ["conv_id", "turn", "h", "level", "at"]
    asked = rows.filter("quotes IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", "h", F.explode("quotes").alias("q")
    ).select(
        "conv_id", "turn", "h", "q.level", "q.at", F.size("q.lines").alias("n"), "q.whole",
        F.explode(F.array_distinct(F.concat("q.lines", F.array("q.whole")))).alias("hash"),
    )
    asked = stage(asked.withColumn("n", F.when(F.col("hash") == F.col("whole"), F.col("n")).otherwise(1)).drop("whole").distinct(), "quoted-lines")
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], LINKS)
    said = stage(originals(rows).join(asked.select("hash").distinct(), "hash", "left_semi").distinct(), "said-lines")
    both = said.select("hash", "conv_id", "turn", F.col("turn").alias("said")).unionByName(
        asked.select("hash", "conv_id", "turn", F.lit(None).cast("long").alias("said"))
    ).groupBy("hash", "conv_id", "turn").agg(F.max("said").alias("said"))
    near = spread_max_before(both, ["hash", "conv_id"], "turn", "said", "earlier").select("hash", "conv_id", "turn", "earlier")
    # The first conversation that says a line, and the first other one.
    firsts = stage(said.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn")), "first-turns")
    one = firsts.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("one"))
    two = firsts.join(one, "hash").filter("conv_id <> one.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("two"))
    far = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).otherwise(F.col("two"))
    found = asked.join(near, ["hash", "conv_id", "turn"]).join(one.join(two, "hash", "left"), "hash", "left").select(
        *passage, "n", F.explode(F.array(
            F.struct(F.col("conv_id").alias("to_conv"), F.col("earlier").alias("to_turn"), F.lit(0).alias("away")),
            F.struct(far["conv_id"].alias("to_conv"), far["turn"].alias("to_turn"), F.lit(1).alias("away")),
        )).alias("c"),
    ).filter("c.to_turn IS NOT NULL")
    votes = found.groupBy(*passage, "c").agg(F.sum("n").alias("votes"))
    latest = F.when(F.col("c.away") == 0, -F.col("c.to_turn")).otherwise(F.col("c.to_conv"))
    best = F.min(F.struct((-F.col("votes")).alias("less"), F.col("c.away"), latest.alias("latest"), F.col("c.to_turn"), F.col("c.to_conv")))
    return votes.groupBy(*passage).agg(best.alias("b")).select(*passage, "b.to_conv", "b.to_turn")


def branches(turns: DataFrame) -> DataFrame:
    """conv_id, branch, path: the reply tree of each conversation by its branches.

    A branch starts at a turn that answers another one than the turn before it. Its path
    lists, from the start of the conversation, the answered turn and the first turn of
    each branch on the way. Paths double in each round, which is written, so the rounds
    grow with the logarithm of the nesting.
    """
    jumps = turns.filter("jump").select("conv_id", F.col("no").alias("branch"), F.col("reply_no").alias("at"))
    starts = turns.select("conv_id", F.col("no").alias("at"), F.col("branch").alias("up"))
    open_ = stage(
        jumps.join(starts, ["conv_id", "at"]).select("conv_id", "branch", "up", F.array("at", "branch").alias("path")), "branches"
    )
    while not open_.filter("up IS NOT NULL").isEmpty():
        above = open_.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        open_ = stage(
            open_.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "branch", F.col("_up").alias("up"),
                F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path"),
            ),
            "branches",
        )
    return open_.select("conv_id", "branch", "path")


def replies(messages: DataFrame) -> DataFrame:
    """Each message without its quotes, what it replies to, and its place in reply order.

    ``reply_conv`` and ``reply_turn`` name the original. ``thread`` lists the places (from
    0) of messages of its conversation that lead to a message, so that sorted by it each
    stands behind the one it replies to; ``position`` is the place in that order, from 1.
    """
    rows = parsed(messages)
    links = stage(
        linked(rows).groupBy("conv_id", "turn", "h").agg(
            F.count("*").alias("n_linked"), F.min(F.struct("level", "at", "to_conv", "to_turn")).alias("best")
        ),
        "links",
    )
    turns = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "h").distinct()
    numbered = stage(spread_row_number(turns, ["conv_id"], [F.asc("turn"), F.asc("h")], "no", "long"), "places")
    before = numbered.select("conv_id", (F.col("no") + 1).alias("no"), F.col("turn").alias("_before"))
    targets = numbered.groupBy("conv_id", "turn").agg(F.min("no").alias("to_no")).select(
        "conv_id", F.col("turn").alias("_to"), "to_no"
    )
    inside = F.when(F.col("best.to_conv") == F.col("conv_id"), F.col("best.to_turn"))
    turns = (
        numbered.join(links, ["conv_id", "turn", "h"], "left").withColumn("_to", inside)
        .join(before, ["conv_id", "no"], "left").join(targets, ["conv_id", "_to"], "left")
    )
    jump = F.coalesce(F.col("to_no") != F.col("no") - 1, F.lit(False))
    turns = turns.select(
        "conv_id", "turn", "h", "no", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.coalesce("best.to_conv", F.when(F.col("_before").isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("best.to_turn", "_before").alias("reply_turn"), F.coalesce("to_no", F.col("no") - 1).alias("reply_no"),
        jump.alias("jump"), F.when(jump, F.col("no")).alias("_jumped"),
    )
    turns = spread_max_before(turns, ["conv_id"], "no", "_jumped", "_branch")
    turns = stage(turns.withColumn("branch", F.coalesce("_jumped", "_branch")).drop("_jumped", "_branch"), "turns")
    path = F.coalesce("path", F.array().cast("array<bigint>"))
    threaded = turns.join(branches(turns), ["conv_id", "branch"], "left").withColumn("thread", F.concat(path, F.array("no")))
    placed = spread_row_number(threaded.drop("path", "branch"), ["conv_id"], [F.asc("thread")], "position", "long").select(
        "conv_id", "turn", "h", "n_linked", "reply_conv", "reply_turn", "position",
        F.array_join(F.transform("thread", lambda n: (n - 1).cast("string")), "/").alias("thread"),
    )
    return rows.join(placed, ["conv_id", "turn", "h"], "left").select(
        "conv_id", "turn", "role", "own_text", F.greatest(F.size("quotes"), F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.col("max_level").cast("long").alias("max_level"),
        "reply_conv", "reply_turn", "thread", "position",
    )

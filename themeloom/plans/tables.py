"""Corpus views over the given tables.

``documents`` with labels, events and embeddings play the reviews; each user
turn of a conversation plays a support ticket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions.text import author_hash, item_id
from themeloom.operators import cleaning, scoring, sentiment
from themeloom.runtime import stage
from themeloom.schema import NOISE
from themeloom.sources.readers import spread

# Test valences for frequent words of the given texts.
LEXICON = [("the", -1.5), ("and", 1.2), ("that", -2.1), ("for", 2.4), ("was", -0.8), ("with", 1.9),
           ("les", -1.7), ("une", 2.2), ("und", 1.4), ("der", -1.1)]
PHRASES = [("of the", 2.6), ("and the", -2.2), ("the and", 0.7), ("and of and", 3.1), ("der und", -1.4)]
TICKET_SEQ = 1_000_000_000_000
# Room for the turns of a conversation in a ticket number.
TURNS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, valence double")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "phrase string, valence double")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, source, text of all feedback, without the joins that fill other columns."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    reviews = docs.select(item_id(F.col("source"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("seq"), "source", "text")
    return reviews.unionByName(_tickets(spark, sf_dir))


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_turns(spark, sf_dir).select(
        item_id(F.lit("support_ticket"), F.concat_ws("-", "conv_id", "turn")).alias("id"),
        (F.col("conv_id") * TURNS + F.col("turn") + TICKET_SEQ).alias("seq"),
        F.lit("support_ticket").alias("source"), "text",
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("timestamp"), "user_id"
    )
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    rating = F.when(F.col("quality") == 1, 4).when(F.col("quality") == 0, 2) - F.col("toxic")
    reviews = (
        docs.join(labels, "doc_id", "left").join(events, "doc_id", "left").join(vectors, "doc_id", "left")
        .select(
            item_id(F.col("source"), F.col("doc_id")).alias("id"),
            F.col("doc_id").alias("seq"), "source", "text",
            rating.cast("double").alias("rating"), "timestamp",
            author_hash(F.col("user_id")).alias("author_hash"), "embedding",
            F.coalesce("label", F.lit(NOISE)).cast("int").alias("cluster_id"),
        )
    )
    tickets = _tickets(spark, sf_dir).withColumn("cluster_id", F.lit(NOISE))
    return reviews.unionByName(tickets, allowMissingColumns=True).withColumn("from_noise", F.lit(False))


_WRITTEN: dict[tuple, DataFrame] = {}


def written(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A stage table of this session: built and written at first use.

    Runs write the cleaned corpus and the signals between stages too; later
    steps read only the columns they need.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = stage(build(), name)
    return _WRITTEN[key]


def cleaned(spark: SparkSession, sf_dir: str, min_chars: int = 15) -> DataFrame:
    """Cleaned rows of at least ``min_chars``. The text is cleaned before the
    write and filtered after it, so its patterns run once per row."""
    rows = written(
        "cleaned", spark, sf_dir, lambda: cleaning.add_clean_text(feedback(spark, sf_dir))
    )
    return cleaning.keep_clean(cleaning.tag_drops(rows, min_chars))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows, one per distinct text."""
    return cleaning.drop_exact_copies(cleaned(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned rows (copies kept and flagged) with sentiment and source age."""


    def build() -> DataFrame:
        # Age and scores come from the cleaned rows, so the join that flags copies, which
        # moves whole rows, runs once; the scores join it by the same key.
        rows = scoring.add_source_age(cleaned(spark, sf_dir))
        scores = sentiment.score_tokens(rows, lexicon(spark), key="seq")
        scored = cleaning.flag_copies(rows).join(scores, "seq", "left")
        return scored.withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))

    return written("signals", spark, sf_dir, build)


def annotations(rows: DataFrame) -> DataFrame:
    """Annotation JSON per cluster, derived from the rows themselves.

    Citations cover the interesting cases by cluster number: exact ids, ids
    without their source, an unknown id, and none at all.
    """
    order = Window.partitionBy("cluster_id").orderBy("seq")
    heads = (
        rows.filter(F.col("cluster_id") != NOISE)
        .select("cluster_id", "seq", "id", F.col("text_clean").alias("head"))
        .withColumn("r", F.row_number().over(order)).filter("r <= 3")
    )
    lists = F.array_sort(F.collect_list(F.struct("r", "id", "head")))
    c = F.col("cluster_id")
    ids = F.transform("h", lambda x: x["id"])
    tails = F.transform("h", lambda x: F.regexp_replace(x["id"], "^[^:]*:", ""))
    cited = (
        F.when(c % 4 == 0, ids).when(c % 4 == 1, tails)
        .when(c % 4 == 2, F.concat(ids, F.array(F.lit("nobody:0"))))
        .otherwise(F.array().cast("array<string>"))
    )
    action = F.struct(
        F.concat(F.lit("Check theme "), c.cast("string")).alias("action"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (c % 3 + 1).cast("int")).alias("effort"),
        F.lit("Seen in feedback").alias("rationale"),
    )
    record = F.struct(
        F.concat(F.lit("Theme "), c.cast("string")).alias("theme_name"),
        F.get("h", F.lit(0))["head"].alias("summary"),
        F.array(F.concat(F.lit("Cause "), c.cast("string"))).alias("root_causes"),
        (c % 5 + 1).alias("severity"),
        F.lit("Given").alias("severity_rationale"),
        F.array(action).alias("recommended_actions"),
        cited.alias("evidence_quote_ids"),
    )
    return heads.groupBy("cluster_id").agg(lists.alias("h")).select("cluster_id", F.to_json(record).alias("raw"))

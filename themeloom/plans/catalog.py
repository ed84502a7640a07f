"""Registered queries: name -> function(spark, sf_dir) -> DataFrame.

Every query reads whole tables. Counts are BIGINT, measures are rounded
doubles, and every order has a tie-break, so results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import coerce, measures, text
from themeloom.operators import (
    annotate, centroids, cleaning, density, embed, evaluate, explore, language, neardup,
    projection, quotes, report, sampling, scoring, sentiment, textindex,
)
from themeloom.plans import tables
from themeloom.plans.flow import analyse
from themeloom.runtime import shared_folder, stage, stage_counting
from themeloom.schema import NOISE
from themeloom.sources import adapters, keyed, raw, readers, sinks, store
from themeloom.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def r4(name: str):
    return F.round(F.col(name).cast("double"), 4).alias(name)


def stamp(name: str = "timestamp"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def pairs(name: str):
    """A count map as one ordered text: a=1;b=2."""
    keys = F.array_sort(F.map_keys(name))
    return F.array_join(
        F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at(name, k).cast("string"))), ";"
    ).alias(name)


# ---------------------------------------------------------------- sources


def _native_reviews(spark, sf):
    docs = tables.table(spark, sf, "documents")
    labels = tables.table(spark, sf, "labels")
    events = tables.table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    rating = F.when(F.col("quality") == 1, 4).when(F.col("quality") == 0, 2) - F.col("toxic")
    return docs.join(labels, "doc_id", "left").join(events, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("reviewId"), F.col("text").alias("content"),
        rating.cast("string").alias("score"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("user_id").cast("string").alias("userName"),
    )


def _native_tickets(spark, sf):
    turns = tables.table(spark, sf, "conversations").filter("role = 'user'")
    sent = F.timestamp_seconds(F.lit(1_500_000_000) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.concat_ws("-", "conv_id", "turn").alias("tweet_id"),
        F.col("conv_id").cast("string").alias("author_id"),
        F.date_format(sent, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.concat(F.lit("@Support_1 "), F.col("text")).alias("text"),
    )


@query
def ingest_reviews(spark, sf):
    return adapters.reviews(_native_reviews(spark, sf), "doc_id").select(
        "id", "seq", "source", "text", "rating", stamp(), "author_hash"
    )


@query
def ingest_tickets(spark, sf):
    return adapters.tickets(_native_tickets(spark, sf), "seq").select("id", "text", stamp(), "author_hash")


@query
def ticket_prefilter(spark, sf):
    turns = tables.table(spark, sf, "conversations").withColumn(
        "inbound", F.when(F.col("role") == "user", "True").when(F.col("role") == "assistant", "False")
    )
    return raw.inbound_mentions(turns, "THE ").select("conv_id", "turn", "text")


@query
def starters(spark, sf):
    turns = tables.table(spark, sf, "conversations").withColumn(
        "reply_to", F.when(F.col("turn") > 0, F.col("turn") - 1)
    )
    return raw.conversation_starters(turns, "reply_to").select("conv_id", "turn")


@query
def starters_only(spark, sf):
    """Enough starters exist, so replies are left out."""
    turns = tables.table(spark, sf, "conversations").withColumn(
        "reply_to", F.when(F.col("turn") > 0, F.col("turn") - 1)
    )
    return raw.conversation_starters(turns, "reply_to", 5).select("conv_id", "turn")


def _folder(spark, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def largest_file(spark, sf):
    """Exports the documents by source, finds the largest export and reads that one."""
    path = _folder(spark, "exports")
    lines = tables.table(spark, sf, "documents").select(F.format_string("%020d", "doc_id").alias("line"), "source")
    sinks.write_by(lines, "source", path)
    largest = readers.folder_sizes(spark, path).first()
    rows = spark.read.schema("line string").csv(largest.folder)
    source = F.lit(largest.folder.rsplit("source=", 1)[1])
    return rows.groupBy(source.alias("source")).agg(
        F.count("*").alias("n_rows"), F.lit(largest.n_bytes).cast("bigint").alias("n_bytes"),
        F.max(F.col("line").cast("bigint")).alias("last_id"),
    )


@query
def dataset_store(spark, sf):
    """Datasets by language, one of which is replaced and one that fails to be, as listed
    by the manifest and as read back."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    held = store.DatasetStore(spark, _folder(spark, "store"))
    name = text.slug(F.concat(F.col("lang"), F.lit(" Feedback")))
    held.write(docs, name)
    held.write(docs.filter("lang = 'en' AND doc_id % 2 = 0"), name)
    try:
        held.write(docs.withColumn("text", F.raise_error(F.lit("lost"))), F.when(F.col("lang") == "de", name))
    except Exception as lost:  # the write that is meant to fail
        if "lost" not in str(lost):
            raise
    back = held.read().groupBy("dataset").agg(F.count("*").alias("n_read"), F.max("doc_id").alias("last_id"))
    return held.datasets().join(back, "dataset").select("dataset", "n_rows", "n_read", "last_id")


@query
def ingest_all(spark, sf):
    reviews = adapters.reviews(_native_reviews(spark, sf), "doc_id")
    tickets = adapters.tickets(_native_tickets(spark, sf), "seq")
    again = tickets.withColumn("seq", F.col("seq") + 10_000_000).withColumn("text", F.lit("copy"))
    return adapters.combine([reviews, tickets, again]).select("id", "seq", "source", F.md5("text").alias("text_md5"))


@query
def ingest_generic(spark, sf):
    rows = _native_reviews(spark, sf)
    return adapters.upload(rows, "doc_id", "App Review (Web)", "content", "score", "at").select(
        "id", "source", "rating", stamp(), F.md5("text").alias("text_md5")
    )


@query
def map_columns(spark, sf):
    rows = _native_reviews(spark, sf).toDF("doc_id", "ticket", "body", "Rating", "created_at", "who")
    roles = adapters.map_upload_columns(rows.columns)
    return rows.select(
        "doc_id", F.md5(roles["text"]).alias("text_md5"),
        F.col(roles["rating"]).alias("rating_text"), F.col(roles["time"]).alias("time_text"),
    )


@query
def item_ids(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select(
        "doc_id", text.item_id(F.col("source"), F.col("doc_id")).alias("native_id"),
        text.item_id(F.col("source"), F.concat(F.lit("row"), F.col("doc_id"))).alias("fallback_id"),
    )


@query
def coerce_rating(spark, sf):
    k = F.get_json_object("props", "$.k")
    form = F.col("event_id") % 5
    value = (
        F.when(form == 0, k).when(form == 1, F.concat(F.lit("  "), k, F.lit(".5 ")))
        .when(form == 2, F.concat(k, F.lit(" stars"))).when(form == 3, F.lit(""))
    )
    return tables.table(spark, sf, "events").select("event_id", coerce.rating(value).alias("rating"))


@query
def coerce_time(spark, sf):
    ts = F.col("ts").cast("timestamp")
    form = F.col("event_id") % 5
    value = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(form == 2, F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy"))
        .when(form == 3, F.concat(F.lit("around "), F.date_format(ts, "yyyy")))
    )
    return tables.table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(coerce.timestamp(value)).alias("epoch")
    )


@query
def author_hash(spark, sf):
    return tables.table(spark, sf, "events").select("event_id", text.author_hash(F.col("user_id")).alias("author_hash"))


@query
def dataset_names(spark, sf):
    docs = tables.table(spark, sf, "documents")
    title = F.col("text")
    file = F.concat(F.col("lang"), F.lit("_feedback_"), F.col("source"), F.lit(".csv"))
    return docs.select(
        "doc_id", text.slug(title).alias("slug"), text.slug(title, "_").alias("source_slug"),
        text.dataset_title(file).alias("title"),
    )


@query
def most_recent(spark, sf):
    events = tables.table(spark, sf, "events").withColumnRenamed("ts", "at")
    return raw.most_recent(events, 30_000, tie="event_id").select("event_id")


@query
def most_recent_cut(spark, sf):
    events = tables.table(spark, sf, "events").withColumnRenamed("ts", "at")
    return raw.most_recent(events, 500, tie="event_id").select("event_id")


@query
def fixed_sample(spark, sf):
    return sampling.fixed_sample(tables.texts(spark, sf).select("id"), 300, 42)


# ---------------------------------------------------------------- cleaning


@query
def clean_text(spark, sf):
    return tables.texts(spark, sf).select("id", text.clean_text(F.col("text")).alias("text_clean"))


@query
def page_urls(spark, sf):
    """URL and handle removal on texts that contain both."""
    said = F.concat(F.lit("see "), F.col("url"), F.lit(" by @user_"), F.col("page_id").cast("string"), F.lit(" ✓ ok"))
    return tables.table(spark, sf, "pages").select("page_id", text.clean_text(said).alias("text_clean"))


@query
def length_filter(spark, sf):
    return tables.cleaned(spark, sf, 30).select("id", F.col("n_chars").cast("bigint").alias("n_chars"))


def _with_language(spark, sf):
    docs = tables.table(spark, sf, "documents")
    model = language.train(docs)
    return language.add_language(cleaning.add_clean_text(tables.feedback(spark, sf)), model)


@query
def lang_score(spark, sf):
    docs = tables.table(spark, sf, "documents")
    model = language.train(docs)
    found = language.add_language(docs.withColumnRenamed("lang", "given"), model, "text")
    return found.groupBy("given", "lang").agg(F.count("*").alias("n")).orderBy("given", "lang")


@query
def lang_profiles(spark, sf):
    """Languages by trigram profiles that are trained by grouping."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "text")
    grams = stage(language.trigrams(docs, "text"), "trigrams")
    profile = stage(language.profiles(grams), "profiles")
    return language.by_profile(grams.select("doc_id", "gram", "n"), profile, "doc_id")


@query
def lang_filter(spark, sf):
    tagged = cleaning.tag_drops(_with_language(spark, sf), language="en")
    return cleaning.keep_clean(tagged).select("id", "lang")


@query
def clean_stats(spark, sf):
    return cleaning.clean_stats(cleaning.tag_drops(cleaning.add_clean_text(tables.feedback(spark, sf)), 30))


@query
def exact_dedupe(spark, sf):
    return tables.corpus(spark, sf).select("id", "seq", F.md5("text_clean").alias("text_md5"))


@query
def dup_stats(spark, sf):
    return cleaning.exact_copy_count(tables.cleaned(spark, sf))


@query
def fingerprint(spark, sf):
    return cleaning.fingerprint(tables.cleaned(spark, sf), "tfidf-1024")


# ---------------------------------------------------------------- vectors


def _vectors(spark, sf):
    return tables.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("seq"), "embedding", F.col("label").cast("int").alias("cluster_id")
    )


@query
def near_dups(spark, sf):
    return neardup.flag_dense(_vectors(spark, sf), 0.4).select("seq", "is_near_dup")


@query
def near_dups_text(spark, sf):
    return neardup.flag_text(tables.corpus(spark, sf), 0.92).select("seq", "is_near_dup")


@query
def embed_tfidf(spark, sf):
    built = embed.tfidf(tables.corpus(spark, sf))
    return built.select("id", "embedding")


@query
def term_weights(spark, sf):
    rows = stage(tables.corpus(spark, sf).select("seq", "text_clean"), "texts")
    return embed.term_weights(rows).select("seq", "term", r4("weight"))


@query
def vector_reuse(spark, sf):
    rows = tables.cleaned(spark, sf)
    labels = tables.table(spark, sf, "labels").withColumnRenamed("doc_id", "seq")
    store = rows.join(labels, "seq", "left_semi").groupBy(
        embed.vector_key("tfidf-1024", F.col("text_clean")).alias("vector_key")
    ).agg(F.first("embedding").alias("embedding"))
    hits, todo = embed.split_by_reuse(rows, store, "tfidf-1024")
    return hits.select("vector_key", F.lit(True).alias("known")).unionByName(
        todo.select("vector_key", F.lit(False).alias("known"))
    )


@query
def vector_store(spark, sf):
    """Vectors of the labelled texts are stored; two runs over all texts then encode only
    what the store lacks, the second nothing."""
    rows = tables.cleaned(spark, sf).select("seq", "text_clean", "embedding")
    labels = tables.table(spark, sf, "labels").withColumnRenamed("doc_id", "seq")
    held = keyed.KeyedStore.create(spark, _folder(spark, "vectors"), "vector_key string, embedding array<float>", "vector_key")
    fill = lambda texts: texts.withColumn("embedding", F.array(F.length("text_clean").cast("float")))
    out = []
    for run, part in enumerate((rows.join(labels, "seq", "left_semi"), rows, rows)):
        _, fresh = embed.embed_with_store(part, held, fill, "tfidf-1024")
        out.append(fresh.select(F.lit(run).cast("bigint").alias("run"), "vector_key"))
    held.compact()
    stored = held.rows().select(F.lit(-1).cast("bigint").alias("run"), "vector_key")
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(stored)


@query
def centroid_vectors(spark, sf):
    cents = centroids.centroids(_vectors(spark, sf))
    return cents.select("cluster_id", "n", F.posexplode("centroid").alias("dim", "value")).select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), "n", F.col("dim").cast("bigint").alias("dim"), r4("value")
    )


@query
def cohesion(spark, sf):
    return centroids.cohesion(_vectors(spark, sf)).select(
        F.col("cluster_id").cast("bigint").alias("cluster_id"), F.round("cohesion", 6).alias("cohesion")
    )


@query
def centroid_rank(spark, sf):
    rows = _vectors(spark, sf)
    placed = centroids.add_centroid_cosine(rows, centroids.centroids(rows))
    return centroids.centroid_rank(placed).select(
        "seq", F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("centroid_rank").cast("bigint").alias("centroid_rank")
    )


@query
def soft_assign(spark, sf):
    rows = _vectors(spark, sf)
    noisy = rows.withColumn("cluster_id", F.when(F.col("cluster_id") >= 7, NOISE).otherwise(F.col("cluster_id")))
    return centroids.soft_assign(noisy, 0.2).select(
        "seq", F.col("cluster_id").cast("bigint").alias("cluster_id"), "from_noise"
    )


@query
def pca_coords(spark, sf):
    return projection.map_coordinates(_vectors(spark, sf)).select("seq", r4("pca_x"), r4("pca_y"))


@query
def pca_energy(spark, sf):
    """With all components, a row keeps its squared distance to the mean."""
    reduced = projection.add_components(_vectors(spark, sf), 64)
    energy = F.aggregate("reduced", F.lit(0.0), lambda total, x: total + x * x)
    return reduced.select("seq", F.round(energy, 4).alias("energy"))


@query
def density_clusters(spark, sf):
    return density.density_clusters(_vectors(spark, sf)).select("seq", "cluster_id")


@query
def tune_grid(spark, sf):
    return density.tune_grid(_vectors(spark, sf))


@query
def kmeans_sweep(spark, sf):
    reduced = projection.add_components(_vectors(spark, sf), 15)
    return evaluate.kmeans_sweep(reduced).select("k", r4("score"))


@query
def silhouette(spark, sf):
    return evaluate.silhouette(_vectors(spark, sf)).select(r4("silhouette"), "n_members")


@query
def silhouette_sweep(spark, sf):
    """Silhouettes of three labelings of the vectors, from the same distances."""
    labels = F.array((F.col("cluster_id") + 1) % 3, F.col("seq") % 4, F.when(F.col("seq") < 7, 0).otherwise(1))
    rows = _vectors(spark, sf).filter("cluster_id >= -1").withColumn("labels", labels.cast("array<int>"))
    return evaluate.silhouettes(rows, "labels", [3, 4, 2]).select(
        F.col("labeling").cast("bigint").alias("labeling"), r4("silhouette"), "n_members"
    )


@query
def silhouette_linear(spark, sf):
    """The squared-distance silhouette, whose work is linear in the rows."""
    score = evaluate.squared_silhouette(_vectors(spark, sf).filter("cluster_id <> -1"))
    return tables.table(spark, sf, "embeddings").filter("label <> -1").agg(
        F.count("*").alias("n_members")
    ).select("n_members", F.round(F.lit(score), 4).alias("silhouette"))


@query
def davies_bouldin(spark, sf):
    return evaluate.davies_bouldin(_vectors(spark, sf)).select(r4("davies_bouldin"), "n_clusters")


@query
def cluster_eval(spark, sf):
    return evaluate.cluster_report(_vectors(spark, sf), "embedding").select("metric", r4("value"))


# ---------------------------------------------------------------- streams

#: Longer than the test tables reach back, so that no row is too late.
HORIZON_DAYS = 36_500


def _arriving(spark, rows):
    """A stream of ``rows`` that arrive out of order and in part twice: the later half by
    event time, then the earlier half, then every seventh row again."""
    path = _folder(spark, "arrivals")
    held = stage(rows, "arriving")
    middle = held.agg(F.percentile_approx(F.col("timestamp").cast("double"), 0.5, 100)).first()[0] or 0.0
    late = F.coalesce(F.col("timestamp").cast("double") < middle, F.lit(False))
    for part in (held.filter(~late), held.filter(late), held.filter("pmod(seq, 7) = 0")):
        part.write.mode("append").parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 3)).parquet(path)


def _drained(spark, writer, path):
    """All that there is goes through the stream, in several micro-batches."""
    running = writer(path, _folder(spark, "stream-state")).trigger(availableNow=True).start()
    running.awaitTermination()
    return path


@query
def stream_clean(spark, sf):
    """Cleaned feedback as it arrives; what arrives again is passed on once."""
    rows = tables.feedback(spark, sf).select("id", "seq", "source", "text", "timestamp")
    cleaned = feeds.clean(_arriving(spark, rows)).dropDuplicates(["id"])
    path = _drained(spark, lambda p, c: feeds.write_batches(cleaned, p, c, "append"), _folder(spark, "stream-clean"))
    return spark.read.parquet(path).select("id", F.md5("text_clean").alias("text_md5"))


@query
def stream_first_copies(spark, sf):
    """The earliest copy of each text, although later copies arrive first."""
    rows = tables.cleaned(spark, sf).select("seq", "text_clean", "timestamp")
    found = feeds.earliest_copies(_arriving(spark, rows), HORIZON_DAYS)
    path = _drained(spark, lambda p, c: feeds.write_batches(found, p, c), _folder(spark, "stream-firsts"))
    return feeds.latest(spark, path, ["text_key"]).select("seq")


@query
def stream_mentions(spark, sf):
    """Mentions a day and source, with late rows and without repeated ones."""
    rows = tables.feedback(spark, sf).filter("timestamp IS NOT NULL").select("id", "seq", "source", "timestamp")
    daily = feeds.daily_mentions(_arriving(spark, rows), f"{HORIZON_DAYS} days", "id")
    path = _drained(spark, lambda p, c: feeds.write_batches(daily, p, c), _folder(spark, "stream-mentions"))
    return feeds.latest(spark, path, ["day", "source"]).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "mentions"
    )


@query
def stream_assign(spark, sf):
    """New vectors as they arrive, each with the nearest known theme."""
    rows = _vectors(spark, sf).withColumn("timestamp", F.timestamp_seconds("seq"))
    known = centroids.centroids(rows.filter("cluster_id < 7"))
    arriving = _arriving(spark, rows.filter("cluster_id >= 7").drop("cluster_id")).dropDuplicates(["seq"])
    path = _drained(spark, lambda p, c: feeds.assign_to_themes(arriving, known, p, c, 0.2), _folder(spark, "stream-assigned"))
    return spark.read.parquet(path).select("seq", F.col("cluster_id").cast("bigint").alias("cluster_id"))


# ---------------------------------------------------------------- signals and scores


@query
def sentiment_scores(spark, sf):
    rows = tables.cleaned(spark, sf).select("id", "text_clean")
    return sentiment.add_sentiment(rows, tables.lexicon(spark)).select("id", r4("sentiment"))


@query
def sentiment_phrases(spark, sf):
    """Sentiment with a table of phrases, the longest of which counts at each place."""
    rows = tables.cleaned(spark, sf).select("id", "text_clean")
    return sentiment.add_sentiment(rows, tables.lexicon(spark), phrases=tables.phrases(spark)).select("id", r4("sentiment"))


@query
def source_age(spark, sf):
    return scoring.add_source_age(tables.cleaned(spark, sf).select("id", "source", "timestamp")).select("id", r4("age_days"))


@query
def severity_prior(spark, sf):
    rows = tables.signals(spark, sf)
    prior = measures.severity_prior(F.col("rating"), F.col("sentiment")).alias("severity_prior")
    return rows.select("id", F.round(prior, 6).alias("severity_prior"))


@query
def per_source(spark, sf):
    return scoring.per_source(tables.cleaned(spark, sf))


@query
def cluster_summary(spark, sf):
    rows = cleaning.flag_copies(tables.cleaned(spark, sf))
    summary = scoring.cluster_summary(rows, centroids.cohesion(rows))
    return summary.select("cluster_id", "n_items", "n_unique", pairs("sources"), r4("cohesion"))


def _scored(spark, sf):
    rows = tables.signals(spark, sf)
    severity = scoring.top_clusters(rows).withColumn("severity", F.col("cluster_id") % 5 + 1)
    return scoring.score_clusters(rows, severity, centroids.cohesion(rows))


def _part(column: str):
    def run(spark, sf):
        return _scored(spark, sf).select("cluster_id", r4(column))

    return run


for _name, _column in {
    "score_frequency": "f_norm", "score_severity": "s_norm", "score_recency": "r_norm", "score_diversity": "d_norm",
}.items():
    _fn = _part(_column)
    _fn.__name__ = _name
    query(_fn)


@query
def score_failed_annotation(spark, sf):
    """Scores when the annotation of the largest cluster failed."""
    rows = tables.signals(spark, sf)
    first = scoring.top_clusters(rows, 1).select("cluster_id")
    severity = scoring.top_clusters(rows).join(first, "cluster_id", "left_anti").withColumn("severity", F.col("cluster_id") % 5 + 1)
    scored = scoring.score_clusters(rows, severity, centroids.cohesion(rows))
    return scored.select("cluster_id", r4("priority_score"), "n_largest")


@query
def recency_now(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return scoring.recency_at(tables.cleaned(spark, sf), now).select("cluster_id", r4("recency"))


@query
def score(spark, sf):
    part = F.transform("score_components", lambda c: c["contribution"])
    return _scored(spark, sf).select(
        "cluster_id", r4("priority_score"), part[0].alias("c_frequency"), part[1].alias("c_severity"),
        part[2].alias("c_recency"), part[3].alias("c_diversity"), "n_sources", pairs("per_source_counts"),
    )


@query
def wilson(spark, sf):
    rows = tables.signals(spark, sf).groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("sentiment") < -0.05).alias("k")
    )
    out = rows
    for level in (0.95, 0.90, 0.99):
        low, high = measures.wilson_bounds(F.col("k"), F.col("n"), level)
        tag = int(level * 100)
        out = out.withColumn(f"low_{tag}", F.round(low, 4)).withColumn(f"high_{tag}", F.round(high, 4))
    return out


@query
def confidence(spark, sf):
    return _scored(spark, sf).select("cluster_id", "confidence.*")


@query
def noise_stats(spark, sf):
    return scoring.noise_stats(tables.cleaned(spark, sf))


@query
def top_clusters(spark, sf):
    return scoring.top_clusters(tables.cleaned(spark, sf))


@query
def top_clusters_cut(spark, sf):
    return scoring.top_clusters(tables.cleaned(spark, sf), 4)


@query
def rank_themes(spark, sf):
    ranked = scoring.rank_themes(stage(_scored(spark, sf), "scored"))
    return ranked.select(F.col("rank").cast("bigint").alias("rank"), "cluster_id", r4("priority_score"), "n_items")


# ---------------------------------------------------------------- quotes and annotations


def _quotable(spark, sf):
    rows = tables.signals(spark, sf)
    return centroids.add_centroid_cosine(rows, centroids.centroids(rows))


@query
def quote_pool(spark, sf):
    return quotes.quote_pool(tables.signals(spark, sf)).select("id", "cluster_id")


def _sample(spark, sf):
    return quotes.quote_sample(quotes.quote_pool(_quotable(spark, sf)))


@query
def quote_sample(spark, sf):
    return _sample(spark, sf).select(
        "cluster_id", "id", F.col("pos").cast("bigint").alias("pos"), F.col("tier").cast("bigint").alias("tier")
    )


@query
def prompt_blocks(spark, sf):
    return quotes.prompt_blocks(_sample(spark, sf)).select("cluster_id", "n_quotes", "quotes_block")


def _prompts(spark, sf):
    rows = _quotable(spark, sf)
    blocks = quotes.prompt_blocks(quotes.quote_sample(quotes.quote_pool(rows)))
    return quotes.cluster_prompts(blocks, scoring.cluster_summary(rows))


@query
def prompt_keys(spark, sf):
    return _prompts(spark, sf).select("cluster_id", "n_items", "prompt_key")


@query
def annotate_themes(spark, sf):
    return annotate.parse(annotate.annotate(_prompts(spark, sf))).select(
        "cluster_id", "analysis.theme_name", "analysis.severity", "valid"
    )


@query
def annotate_reuse(spark, sf):
    prompts = stage(_prompts(spark, sf), "prompts")
    known = stage(annotate.annotate(prompts.filter("n_items >= 50")).select("prompt_key", "raw"), "known")
    answers, _ = annotate.annotate_with_reuse(prompts, known)
    return answers.select("cluster_id", "cached", F.col("raw").isNotNull().alias("answered"))


@query
def parse_annotations(spark, sf):
    made = tables.annotations(tables.cleaned(spark, sf))
    # Spoil some answers the way real ones fail.
    c = F.col("cluster_id")
    spoiled = made.withColumn(
        "raw",
        F.when(c == 1, F.replace("raw", F.lit('"severity":2'), F.lit('"severity":9')))
        .when(c == 2, F.replace("raw", F.lit('"effort":"high"'), F.lit('"effort":"huge"')))
        .when(c == 3, F.lit("not json")).otherwise(F.col("raw")),
    )
    a = F.col("analysis")
    return annotate.parse(spoiled).select(
        "cluster_id", "valid",
        F.when(F.col("valid"), a["theme_name"]).alias("theme_name"),
        F.when(F.col("valid"), a["severity"].cast("bigint")).alias("severity"),
    )


@query
def citations(spark, sf):
    rows = tables.cleaned(spark, sf)
    parsed = annotate.parse(tables.annotations(rows))
    cited = parsed.select("cluster_id", F.col("analysis.evidence_quote_ids").alias("cited_ids"))
    return annotate.verify_citations(cited, rows.filter(F.col("cluster_id") != NOISE)).select(
        "cluster_id", "citation_check_passed", "citation_check_detail",
        F.array_join("resolved_ids", ",").alias("resolved_ids"),
    )


# ---------------------------------------------------------------- artefacts and read path

_STORED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(corpus, insights) as written by a run; the read path starts from them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        rows = stage(_quotable(spark, sf_dir), "corpus")
        _STORED[key] = analyse(rows, tables.annotations(rows))
    return _STORED[key]


@query
def insights_json(spark, sf):
    _, insights = stored(spark, sf)
    record = F.to_json(F.struct("cluster_id", "analysis", "priority_score", "confidence", "per_source_counts"))
    return insights.select("cluster_id", record.alias("record")).select(
        "cluster_id",
        F.get_json_object("record", "$.analysis.theme_name").alias("theme_name"),
        F.get_json_object("record", "$.confidence.badge").alias("badge"),
        F.get_json_object("record", "$.confidence.n_items").cast("bigint").alias("n_items"),
    )


@query
def insights_roundtrip(spark, sf):
    _, insights = stored(spark, sf)
    text_rows = insights.select(F.to_json(F.struct("*")).alias("line"))
    back = text_rows.select(F.from_json("line", insights.schema).alias("i")).select("i.*")
    return back.select(
        "cluster_id", r4("priority_score"), pairs("per_source_counts"), F.explode("representative_quotes").alias("q")
    ).select("cluster_id", "priority_score", "per_source_counts", F.col("q.id").alias("quote_id"))


def _insight_files(spark, sf) -> str:
    """Folder of the insights as JSON lines, with a broken line in a file of its own."""
    _, insights = stored(spark, sf)
    path = _folder(spark, "insights")
    sinks.write_insights(insights, path)
    broken = insights.orderBy("cluster_id").limit(1).select(F.substring(F.to_json(F.struct("*")), 1, 40).alias("value"))
    broken.write.mode("append").text(path)
    return path


@query
def insight_files(spark, sf):
    """Insights written as JSON files and read back by their schema; a broken line
    becomes a row of its own."""
    back = readers.read_records(spark, _insight_files(spark, sf), stored(spark, sf)[1].schema)
    return back.select(
        "cluster_id", "analysis.theme_name", "confidence.badge", F.col("confidence.n_items").cast("bigint").alias("n_items"),
        r4("priority_score"), F.col("_broken").isNotNull().alias("broken"),
    )


@query
def insight_csv(spark, sf):
    """The insight table as a CSV file and back."""
    path = _folder(spark, "insight-table")
    sinks.write_csv(insight_table(spark, sf), path)
    back = readers.read_csv(spark, path)
    return back.select("rank", "theme", F.col("items").cast("bigint").alias("items"), "confidence", "sources", "citations_ok", F.col("cluster_id").cast("int").alias("cluster_id"))


@query
def run_stats(spark, sf):
    """Counters that are gathered while the stages of a run write their rows."""
    tagged = cleaning.tag_drops(cleaning.add_clean_text(tables.feedback(spark, sf)))
    noise = F.count_if(F.col("drop_reason").isNull() & (F.col("cluster_id") == NOISE))
    rows, counts = stage_counting(tagged, "tagged", **cleaning.drop_counters(), noise=noise)
    kept = cleaning.keep_clean(rows)
    _, unique = stage_counting(cleaning.drop_exact_copies(kept).select("seq"), "unique", n=F.count(F.lit(1)))
    sizes = kept.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id").count()
    n = counts["output"]
    return sizes.agg(
        *[F.lit(counts[c]).cast("bigint").alias(c) for c in cleaning.drop_counters()],
        F.lit(n - unique["n"]).cast("bigint").alias("exact_copies"), F.count("*").alias("n_clusters"),
        F.round(F.lit(counts["noise"] / n if n else 0.0), 4).alias("noise_share"),
    )


@query
def insight_table(spark, sf):
    table = report.insight_table(stored(spark, sf)[1])
    return table.select(F.col("rank").cast("bigint").alias("rank"), "theme", r4("priority"),
                        F.col("severity").cast("bigint").alias("severity"), "items", "confidence", "sources",
                        "citations_ok", "cluster_id")


@query
def report_blocks(spark, sf):
    return report.report_blocks(stored(spark, sf)[1]).select(F.col("rank").cast("bigint").alias("rank"), "block")


@query
def workspaces(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return docs.select(text.slug(F.concat(F.col("lang"), F.lit(" Feedback"))).alias("workspace")).distinct().orderBy("workspace")


@query
def filter_insights(spark, sf):
    _, insights = stored(spark, sf)
    kept = explore.filter_insights(insights, min_items=30, only_ok=True, sources=("src3", "src5"))
    return kept.select("cluster_id", r4("priority_score"))


def _themed(spark, sf):
    rows, insights = stored(spark, sf)
    return explore.with_theme(rows, insights.select("cluster_id", "analysis.theme_name"))


@query
def theme_join(spark, sf):
    return _themed(spark, sf).groupBy("theme").agg(F.count("*").alias("n_items"))


@query
def search_unicode(spark, sf):
    return explore.search(_themed(spark, sf), pattern="ÉMENT|ÜCHT|ÑAS").select("id", "source", "theme")


@query
def search(spark, sf):
    return explore.search(_themed(spark, sf), pattern="th(e|at) .*with").select(
        "id", "source", "theme", "rating", r4("sentiment"), stamp()
    )


_INDEXES: dict[tuple, textindex.TextIndex] = {}


def _index(spark, sf) -> textindex.TextIndex:
    """The trigram index of the stored corpus, as written once for all searches. It holds
    the columns that a search returns."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        rows = _themed(spark, sf).select("seq", "id", "text", "source", "theme", "rating", "sentiment", "timestamp")
        _INDEXES[key] = textindex.TextIndex.build(rows, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    return _INDEXES[key]


@query
def search_indexed(spark, sf):
    """The rows of ``search``, of which only those with the pattern's rarest trigrams are read."""
    pattern = "th(e|at) .*with"
    return explore.search(_index(spark, sf).fetch(spark, pattern), pattern).select(
        "id", "source", "theme", "rating", r4("sentiment"), stamp()
    )


@query
def search_unicode_indexed(spark, sf):
    pattern = "ÉMENT|ÜCHT|ÑAS"
    return explore.search(_index(spark, sf).fetch(spark, pattern), pattern).select("id", "source", "theme")


@query
def fold_themes(spark, sf):
    return explore.fold_themes(_themed(spark, sf), 4).groupBy("theme_view").agg(F.count("*").alias("n_items"))


@query
def map_points(spark, sf):
    folded = explore.fold_themes(_themed(spark, sf))
    return explore.map_points(projection.map_coordinates(folded)).select(
        "id", r4("pca_x"), r4("pca_y"), "theme_view", "source", "short_text"
    )


@query
def theme_members(spark, sf):
    rows, insights = stored(spark, sf)
    best = scoring.rank_themes(insights).filter("rank = 1").select("cluster_id")
    members = rows.join(best, "cluster_id", "left_semi").select("id")
    return explore.theme_members(rows, members).select("id", "cluster_id")


@query
def monthly_trend(spark, sf):
    rows, insights = stored(spark, sf)
    best = scoring.rank_themes(insights).filter("rank = 1").select("cluster_id")
    return explore.monthly_mentions(rows.join(best, "cluster_id", "left_semi"), "yyyy-MM-dd")


@query
def monthly_orders(spark, sf):
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    return explore.monthly_mentions(orders)


@query
def month_source_pivot(spark, sf):
    orders = tables.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderpriority").alias("source")
    )
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = explore.month_by_source(orders, names)
    return wide.select("month", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("p" + n[0]) for n in names])


@query
def describe_by_source(spark, sf):
    out = explore.describe_by(tables.signals(spark, sf), "source", "sentiment")
    return out.select("source", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query
def length_hist(spark, sf):
    return explore.histogram(tables.cleaned(spark, sf), F.col("n_chars")).select(
        F.col("bin").cast("bigint").alias("bin"), "n"
    )


@query
def dup_share(spark, sf):
    return explore.near_dup_share(cleaning.flag_copies(tables.cleaned(spark, sf))).select("cluster_id", r4("near_dup_share"))


@query
def rating_dist(spark, sf):
    return explore.rating_distribution(tables.cleaned(spark, sf))


@query
def kpis(spark, sf):
    rows, insights = stored(spark, sf)
    return explore.kpis(insights, rows)


@query
def badge_hist(spark, sf):
    return explore.badge_histogram(stored(spark, sf)[1])


@query
def labels_map(spark, sf):
    _, insights = stored(spark, sf)
    return insights.select(
        "cluster_id", explore.badge_label(F.col("confidence.badge")).alias("badge"),
        explore.severity_chip(F.col("analysis.severity")).alias("severity"),
    )


@query
def source_labels(spark, sf):
    counts = scoring.per_source(tables.cleaned(spark, sf))
    return counts.select(explore.source_label(F.col("source")).alias("label"), "n_items")


@query
def insight_detail(spark, sf):
    return report.insight_detail(stored(spark, sf)[1]).select(
        "cluster_id", F.col("pos").cast("bigint").alias("pos"), "id", "meta", "starred"
    )


@query
def sample_per_cluster(spark, sf):
    return evaluate.coherence_sample(tables.cleaned(spark, sf), clusters=5).select(
        "cluster_id", F.col("pick").cast("bigint").alias("pick"), "id", "text"
    )


@query
def last_turns(spark, sf):
    return explore.last_turns(tables.table(spark, sf, "conversations"))


@query
def chat_prompts(spark, sf):
    history = explore.last_turns(tables.table(spark, sf, "conversations"))
    return explore.chat_prompt(history, "What should we fix first?").select("conv_id", F.md5("prompt").alias("prompt_md5"))


@query
def fallback_summary(spark, sf):
    return report.fallback_summary(stored(spark, sf)[1]).select(
        "headline", "summary", F.array_join("suggested_focus", "|").alias("suggested_focus")
    )


@query
def synthesis_context(spark, sf):
    rows, insights = stored(spark, sf)
    return report.synthesis_context(insights, rows).select("themes_block", "prompt_key")


@query
def grounding_text(spark, sf):
    rows, insights = stored(spark, sf)
    return report.grounding_text(insights, rows, report.fallback_summary(insights))

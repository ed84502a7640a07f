"""Native columns to the unified schema.

An adapter is a function DataFrame -> DataFrame; ``ADAPTERS`` is the extension
point. ``seq`` is the explicit row order that keep-first rules depend on, so
callers pass a column that comes from the data (a native id or file offset).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions import coerce, text
from themeloom.operators.cleaning import keep_first
from themeloom.operators.sampling import fixed_sample
from themeloom.schema import UNIFIED

# Fixed candidate lists, first present column wins.
TEXT_COLUMNS = ["review_text", "content", "Review", "review"]
RATING_COLUMNS = ["review_rating", "score", "Rating", "rating"]
TIME_COLUMNS = ["review_timestamp", "at", "Time_submitted", "date"]
ID_COLUMNS = ["review_id", "reviewId", "id"]
AUTHOR_COLUMNS = ["pseudo_author_id", "author_name", "userName", "user_name"]
UPLOAD_TEXT_COLUMNS = TEXT_COLUMNS + ["feedback", "comment", "message", "body", "answer"]
UPLOAD_TIME_COLUMNS = TIME_COLUMNS + ["date", "created_at", "Date"]
SOURCE_SPAN = 1 << 44
TICKET_COLUMNS = {"tweet_id", "author_id", "created_at", "text"}


def first_present(columns: Iterable[str], candidates: list[str]) -> str | None:
    present = set(columns)
    return next((name for name in candidates if name in present), None)


def map_upload_columns(columns: list[str]) -> dict[str, str | None]:
    """Guessed roles of an uploaded table's columns; text falls back to the first."""
    return {
        "text": first_present(columns, UPLOAD_TEXT_COLUMNS) or columns[0],
        "rating": first_present(columns, RATING_COLUMNS),
        "time": first_present(columns, UPLOAD_TIME_COLUMNS),
    }


def _unified(df: DataFrame, **columns: Column) -> DataFrame:
    empty = {field.name: F.lit(None) for field in UNIFIED.fields}
    chosen = {**empty, **columns}
    return df.select(
        *[chosen[f.name].cast(f.dataType).alias(f.name) for f in UNIFIED.fields]
    )


def _provenance(df: DataFrame) -> Column:
    if "_file" not in df.columns:
        return F.lit(None)
    return F.create_map(F.lit("dataset_file"), F.col("_file"))


def reviews(
    df: DataFrame,
    seq: str,
    source: str = "play_store_review",
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """App reviews under any of the known column layouts."""
    text_col = first_present(df.columns, TEXT_COLUMNS)
    if text_col is None:
        raise ValueError(f"no review text column among {df.columns}")
    roles = {
        role: first_present(df.columns, names)
        for role, names in {
            "rating": RATING_COLUMNS, "time": TIME_COLUMNS,
            "id": ID_COLUMNS, "author": AUTHOR_COLUMNS,
        }.items()
    }
    native = F.col(roles["id"]) if roles["id"] else F.concat(F.lit("row"), F.col(seq))
    none = F.lit(None)
    out = _unified(
        df.dropna(subset=[text_col]),
        id=text.item_id(F.lit(source), native),
        seq=F.col(seq),
        source=F.lit(source),
        text=F.col(text_col),
        rating=coerce.rating(F.col(roles["rating"])) if roles["rating"] else none,
        timestamp=coerce.timestamp(F.col(roles["time"])) if roles["time"] else none,
        author_hash=text.author_hash(F.col(roles["author"])) if roles["author"] else none,
        metadata=_provenance(df),
    )
    return out if sample_size is None else fixed_sample(out, sample_size, seed)


def tickets(
    df: DataFrame,
    seq: str,
    source: str = "support_ticket",
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Support tickets; @handles are routing noise and are removed."""
    missing = TICKET_COLUMNS - set(df.columns)
    if missing:
        raise ValueError(f"ticket table lacks columns {sorted(missing)}")
    out = _unified(
        df.dropna(subset=["text"]),
        id=text.item_id(F.lit(source), F.col("tweet_id")),
        seq=F.col(seq),
        source=F.lit(source),
        text=text.drop_handles(F.col("text")),
        timestamp=coerce.timestamp(F.col("created_at")),
        author_hash=text.author_hash(F.col("author_id")),
        metadata=_provenance(df),
    )
    return out if sample_size is None else fixed_sample(out, sample_size, seed)


def upload(
    df: DataFrame,
    seq: str,
    source_label: str,
    text_col: str,
    rating_col: str | None = None,
    time_col: str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Any table with a text column; ``max_rows`` keeps the first rows by ``seq``.

    Ids are built from ``seq`` instead of a gap-free position, which would need
    a global numbering pass.
    """
    label = text.slug(F.lit(source_label), joiner="_")
    none = F.lit(None)
    rows = df.dropna(subset=[text_col])
    if max_rows is not None:
        rows = rows.orderBy(seq).limit(max_rows)
    return _unified(
        rows,
        id=text.item_id(label, F.col(seq)),
        seq=F.col(seq),
        source=label,
        text=F.col(text_col).cast("string"),
        rating=coerce.rating(F.col(rating_col)) if rating_col else none,
        timestamp=coerce.timestamp(F.col(time_col)) if time_col else none,
    )


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "play_store_review": reviews,
    "support_ticket": tickets,
    "upload": upload,
}


def combine(frames: list[DataFrame]) -> DataFrame:
    """Union of sources, one row per id; an earlier source or row wins.

    ``seq`` is unique inside a source and below 2^44; the source number is put
    above it, so it is the row order of the concatenated sources.
    """
    if not frames:
        raise ValueError("no feedback source given")
    ordered = [
        frame.withColumn("seq", F.col("seq") + F.lit(i * SOURCE_SPAN)) for i, frame in enumerate(frames)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)
    return keep_first(union, F.col("id"))

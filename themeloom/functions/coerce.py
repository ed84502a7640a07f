"""Tolerant conversions: a bad value becomes null and never fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Fixed formats tried after Spark's own ISO parsing. The last one is the
# weekday-led tweet date with its weekday cut off.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)
WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? "
TWEET_FORMAT = "MMM dd HH:mm:ss Z yyyy"


def rating(col: Column) -> Column:
    text = col.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def finite(col: Column) -> Column:
    """NaN to null for sources that already carry doubles."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def timestamp(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    attempts = [F.try_to_timestamp(text)]
    attempts += [F.try_to_timestamp(text, F.lit(fmt)) for fmt in TIME_FORMATS]
    no_weekday = F.regexp_replace(text, WEEKDAY, "")
    attempts.append(
        F.when(text.rlike(WEEKDAY), F.try_to_timestamp(no_weekday, F.lit(TWEET_FORMAT)))
    )
    return F.coalesce(*attempts)

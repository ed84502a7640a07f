"""Text expressions. Everything here is a built-in column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: URLs, @handles, and every symbol outside letters, digits,
# underscore, white space and basic punctuation. ``(?U)`` gives Unicode spaces.
URL = r"(?U)https?://\S+|www\.\S+"
HANDLE = r"@[\p{L}\p{N}_]+"
SYMBOL = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f.,!?'\"()\-:;/$%&+]"
SPACES = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(col: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(col, EDGE_SPACES, "")


def clean_text(col: Column) -> Column:
    out = col
    for pattern in (URL, HANDLE, SYMBOL, SPACES):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def drop_handles(col: Column) -> Column:
    return strip(F.regexp_replace(col, HANDLE, ""))


def text_hash(col: Column) -> Column:
    """Identity of a text up to case and outer white space."""
    return F.sha1(F.encode(strip(F.lower(col)), "UTF-8"))


def author_hash(col: Column) -> Column:
    return F.substring(F.sha1(F.encode(col.cast("string"), "UTF-8")), 1, 12)


def item_id(source: Column, native: Column) -> Column:
    return F.concat(source, F.lit(":"), native.cast("string"))


def slug(col: Column, joiner: str = "-", default: str = "upload") -> Column:
    """Lower-case name whose other characters collapse to ``joiner``."""
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    bare = F.coalesce(F.nullif(F.trim(dashed, F.lit("-")), F.lit("")), F.lit(default))
    return F.replace(bare, F.lit("-"), F.lit(joiner)) if joiner != "-" else bare


def dataset_title(file_name: Column) -> Column:
    """Default dataset name of a file: no extension, blanks, title case."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.initcap(F.replace(stem, F.lit("_"), F.lit(" ")))


def after_first_colon(col: Column) -> Column:
    return F.regexp_replace(col, "^[^:]*:", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | (F.length(strip(col)) == 0)

"""Text expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def named(column: str) -> Column:
    """The column of that exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def strip(value: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_missing(value: Column) -> Column:
    """True for null and for text that is empty after stripping."""
    return F.coalesce(strip(value.cast("string")), F.lit("")) == ""


def label_or(value: Column, fallback: str) -> Column:
    """Stripped text, or ``fallback`` where nothing is left."""
    return F.coalesce(F.nullif(strip(value.cast("string")), F.lit("")), F.lit(fallback))


def cut(value: Column, width: int) -> Column:
    return F.substring(value, 1, width)


def contains_text(value: Column, needle: str) -> Column:
    """Case-insensitive substring test; null counts as empty text."""
    return F.coalesce(F.lower(value.cast("string")), F.lit("")).contains(needle.lower())


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def file_stem(path: Column) -> Column:
    """Last path component without its final suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def table_name(path: Column, fallback: str = "dataset") -> Column:
    """SQL table name of a file path: lower-case stem, other characters folded to ``_``."""
    folded = F.regexp_replace(F.lower(file_stem(path)), "[^a-z0-9_]+", "_")
    return F.coalesce(F.nullif(F.btrim(folded, F.lit("_")), F.lit("")), F.lit(fallback))

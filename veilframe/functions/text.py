"""Text and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: no white space, of which str.strip() and str.split() know more than the regex class.
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def normalize_newlines(text: Column) -> Column:
    """Carriage returns, alone or before a newline, become newlines."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_BLANK)


def suffix(filename: Column) -> Column:
    """The last .ext of a path's last component; empty for dot files, a trailing dot and a null name."""
    return F.coalesce(F.regexp_extract(filename, r"[^/.][^/]*?(\.[^/.]+)$", 1), F.lit(""))


def clip(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both bounds within the text."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def wrapped_context(text: Column, start: Column, end: Column, around: int = 100) -> Column:
    """What a slice from start - around to end + around gives where a negative bound counts from the text's end."""
    n = F.length(text)
    low = F.when(start >= around, start - around).otherwise(F.greatest(n + start - around, F.lit(0)))
    high = F.least(end + around, n)
    return F.when(low < high, F.substring(text, low + 1, high - low)).otherwise("")


def context(text: Column, start: Column, end: Column, around: int = 50) -> Column:
    low = F.greatest(start - around, F.lit(0))
    return F.substring(text, low + 1, end + around - low)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")

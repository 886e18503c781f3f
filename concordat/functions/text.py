"""Text helpers as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def strip(x: Column) -> Column:
    """White space of any script removed from both ends."""
    return F.regexp_replace(x, rf"^{V.SPACE}+|[\s\x1c-\x1f]+$", "")


def bare(column: str) -> Column:
    """``strip`` of a column, nothing for a null; most texts begin and end with a plain character and stay as they are."""
    x = F.coalesce(F.col(column).cast("string"), F.lit(""))
    plain = F.ascii(x).between(33, 126) & F.ascii(F.right(x, F.lit(1))).between(33, 126)
    return F.when(plain, x).otherwise(strip(x))


def let(bound: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once for a row, however often the body names it."""
    return F.element_at(F.transform(F.array(bound), body), 1)


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, V.SPACE + "+", " "))


def blank(x: Column) -> Column:
    """Null, empty or white space only."""
    return x.isNull() | ~F.regexp_like(x, F.lit(V.NO_SPACE))


def lines(text: Column) -> Column:
    """The lines of a text; what follows the last line break counts only if it is not empty."""
    parts = F.split(F.coalesce(text, F.lit("")), V.LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern, without regard to case."""
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))


def distinct(xs: Column, lower: bool = False) -> Column:
    """Distinct stripped values, sorted."""
    return F.array_sort(F.array_distinct(F.transform(xs, lambda x: F.lower(strip(x)) if lower else strip(x))))


def has_digit(x: Column) -> Column:
    return F.regexp_like(x, F.lit("[0-9]"))


def numbers(text: Column) -> Column:
    """Number-like tokens that hold a digit, stripped."""
    raw = F.regexp_extract_all(text, F.lit(V.NUMBER), F.lit(0))
    return F.transform(F.filter(raw, has_digit), strip)


def short_hash(x: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)

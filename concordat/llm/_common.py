"""Helpers of the training-data operators: reading inputs, let-bindings for native expressions, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import durable, join_frequent, remove, shared_folder, spread, tables_removed, written

__all__ = ["durable", "join_frequent", "let", "remove", "shared_folder", "spread", "table", "tables_removed", "word_count", "words", "written"]

#: Words are maximal runs of anything but these six ASCII white-space characters.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order, as an array; empty for a null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def word_count(text: Column) -> Column:
    """The number of words, without building them as an array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    gaps = F.length(F.regexp_replace(trimmed, WS_RUN, " ")) - F.length(F.regexp_replace(trimmed, WS_RUN, ""))
    return F.when(trimmed == "", F.lit(0)).otherwise(gaps + 1).cast("long")

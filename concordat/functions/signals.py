"""Quantitative signals of pages and lines as column functions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import distinct, found, has_digit, lines, numbers, strip

#: Bits of a text's ``gates``, and the patterns that texts with a bit may match and no others do.
NUMBERS, CURRENCIES, UNITS, METRICS, TIMES, BOILERPLATES = (1 << k for k in range(6))
_GATES = {NUMBERS: "[0-9]", CURRENCIES: V.CURRENCY_OTHER, UNITS: V.PAGE_UNIT, METRICS: V.PAGE_METRIC, TIMES: V.PAGE_TIME, BOILERPLATES: V.BOILERPLATE}


def gates(text: Column) -> Column:
    """Which patterns a text may match, as bits, found by the automata of RE2, at a small part of the patterns' cost.

    RE2's white space lacks one character, which is added, and ``\\b`` knows ASCII letters only there, so that it
    finds more bounds and never fewer at an ASCII letter or digit. What it passes is read by the patterns themselves.
    """
    asked = {bit: pattern.replace(r"\s", r"[\s\x0b]") for bit, pattern in _GATES.items()}

    def held(texts: pa.Array) -> pa.Array:
        out = pa.array([0] * len(texts), pa.int32())
        for bit, pattern in asked.items():
            hit = pc.match_substring_regex(texts, pattern, ignore_case=True)
            out = pc.bit_wise_or(out, pc.if_else(hit, pa.scalar(bit, pa.int32()), pa.scalar(0, pa.int32())))
        return out

    return F.arrow_udf(held, "int")(F.coalesce(text, F.lit("")))


def _gated(gate: Column, bit: int, tokens: Column, others: Column | None = None) -> Column:
    others = F.array().cast("array<string>") if others is None else others
    return F.when(gate.bitwiseAND(bit) != 0, tokens).otherwise(others)


def currency(text: Column, gate: Column) -> Column:
    """``gate``: as of ``gates``, here and below."""
    common = F.regexp_extract_all(text, F.lit(V.CURRENCY_COMMON), F.lit(0))
    return distinct(_gated(gate, CURRENCIES, found(text, V.CURRENCY), common))


def unit(text: Column, gate: Column) -> Column:
    return _gated(gate, UNITS, distinct(found(text, V.PAGE_UNIT), lower=True))


def metric(text: Column, gate: Column) -> Column:
    return _gated(gate, METRICS, distinct(found(text, V.PAGE_METRIC), lower=True))


def temporal(text: Column, gate: Column) -> Column:
    return _gated(gate, TIMES, distinct(found(text, V.PAGE_TIME)))


def boilerplate(text: Column, gate: Column) -> Column:
    return _gated(gate, BOILERPLATES, distinct(found(text, V.BOILERPLATE), lower=True))


def table_rows(text: Column, gate: Column) -> Column:
    """Lines with two numbers or more among three words or more."""

    def tabular(line: Column) -> Column:
        return (F.size(numbers(strip(line))) >= 2) & (F.size(F.split(strip(line), V.SPACE + "+")) >= 3)

    # lines without a digit are passed over before anything is extracted from them
    return F.when(gate.bitwiseAND(NUMBERS) != 0, F.size(F.filter(F.filter(lines(text), has_digit), tabular))).otherwise(0)


def page_numbers(text: Column, gate: Column) -> Column:
    return _gated(gate, NUMBERS, numbers(text))


def line_signals(line: Column, min_digits: int = 1) -> tuple[Column, Column, Column]:
    """Signals, anchors and the size of the numeric ones of a stripped line."""
    nums = numbers(line)
    able = F.filter(nums, lambda n: F.length(F.regexp_replace(n, "[^0-9]", "")) >= min_digits)
    money, units, metrics, times = (found(line, p) for p in (V.CURRENCY, V.LINE_UNIT, V.LINE_METRIC, V.LINE_TIME))
    table = (F.size(nums) >= 2) | (F.size(found(line, V.YEAR_COLUMN)) >= 2)
    tags = F.array_compact(
        F.array(
            F.when(F.size(able) > 0, "numeric"),
            F.when(F.size(money) > 0, "currency"),
            F.when(F.size(units) > 0, "unit"),
            F.when(F.contains(line, F.lit("%")), "percentage"),
            F.when(F.size(metrics) > 0, "metric_keyword"),
            F.when(F.size(times) > 0, "temporal"),
            F.when(table, "table_row"),
        )
    )
    cut = lambda xs, n: F.transform(F.slice(xs, 1, n), strip)
    return tags, F.concat(cut(able, 3), cut(money, 2), cut(units, 2), cut(metrics, 2), cut(times, 2)), F.size(able)


def fact_bearing(line: Column, tags: Column, anchors: Column) -> Column:
    """A number with context, a table row with a number, or a number of two digits, a percentage or a plus sign."""
    has = lambda t: F.array_contains(tags, t)
    number = has("numeric") | has("percentage")
    context = has("currency") | has("unit") | has("metric_keyword") | has("temporal") | has("percentage")
    strong = F.regexp_like(line, F.lit(r"[0-9]{2}")) | F.contains(line, F.lit("%")) | F.contains(line, F.lit("+"))
    return number & (context | has("table_row") | ((F.size(anchors) > 0) & strong))

"""Fact-bearing lines and the windows around them.

A page's lines stay in its row as an array, so detection, widening and merging need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions.text import has_digit, lines, strip

RADIUS, GAP, HEADER_LINES = 2, 2, 2
JOINER = "\n\n---\n\n"
REGION = "array<struct<line_no:int,anchor:string,signals:array<string>,line:string>>"
WINDOW = "array<struct<start:int,end:int,anchors:array<string>,signals:array<string>>>"


def regions(page_lines: Column) -> Column:
    """The fact-bearing lines, as an array of line number, anchor, signals and the stripped line."""

    def read(line: Column, i: Column) -> Column:
        x = strip(line)
        tags, anchors, _ = S.line_signals(x)
        return F.struct(i.alias("line_no"), anchors.alias("anchors"), tags.alias("signals"), x.alias("line"))

    # Every region has a number or a percentage, so other lines are passed over before they are read.
    able = lambda x: has_digit(x["line"]) | F.contains(x["line"], F.lit("%"))
    numbered = F.transform(page_lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    seen = F.transform(F.filter(numbered, able), lambda x: read(x["line"], x["i"]))
    kept = F.filter(seen, lambda r: S.fact_bearing(r["line"], r["signals"], r["anchors"]))
    anchor = lambda r: F.when(F.size(r["anchors"]) > 0, F.array_join(F.slice(r["anchors"], 1, 3), ", ")).otherwise(F.substring(r["line"], 1, 30))
    return F.transform(kept, lambda r: F.struct(r["line_no"].alias("line_no"), anchor(r).alias("anchor"), r["signals"].alias("signals"), r["line"].alias("line")))


def windows(found: Column, total: Column, radius: int = RADIUS, gap: int = GAP, header_lines: int = HEADER_LINES) -> Column:
    """Regions widened by ``radius`` lines and merged where at most ``gap`` lines lie between them.

    The first window takes in the top of the page if it starts near it.
    """
    spans = F.transform(
        found,
        lambda r: F.struct(
            F.greatest(F.lit(0), r["line_no"] - radius).alias("start"),
            F.least(total - 1, r["line_no"] + radius).alias("end"),
            F.array(r["anchor"]).alias("anchors"),
            r["signals"].alias("signals"),
        ),
    )

    def add(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], w["end"]).alias("end"),
            F.array_union(last["anchors"], w["anchors"]).alias("anchors"),
            F.array_union(last["signals"], w["signals"]).alias("signals"),
        )
        merges = (F.size(acc) > 0) & (w["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + gap + 1)
        return F.when(merges, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(w)))

    merged = F.aggregate(spans, F.array().cast(WINDOW), lambda acc, w: add(acc, w).cast(WINDOW))
    top = lambda w, i: F.when((i == 0) & (w["start"] <= header_lines + 1), F.lit(0)).otherwise(w["start"])
    return F.transform(merged, lambda w, i: F.struct(top(w, i).alias("start"), w["end"].alias("end"), w["anchors"].alias("anchors"), w["signals"].alias("signals")))


def with_regions(pages: DataFrame) -> DataFrame:
    """Pages with ``lines`` and ``regions``."""
    return pages.withColumn("lines", lines(F.col("text"))).withColumn("regions", regions(F.col("lines")))


def _each(pages: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each entry of an array.

    From a plain ``explode`` follows a filter on the array's size, which would evaluate all that makes the
    array once more for every condition; of an outer one the empty rows are dropped afterwards.
    """
    return pages.select("document_id", "page_number", F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def line_regions(pages: DataFrame) -> DataFrame:
    """One row for every fact-bearing line."""
    rows = _each(with_regions(pages), "regions", "r")
    return rows.select("document_id", "page_number", "r.line_no", F.col("r.anchor").alias("anchor_text"), "r.signals", F.col("r.line").alias("line_text"))


def with_windows(pages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pages with their windows, each with its text."""
    wide = with_regions(pages).withColumn("w", windows(F.col("regions"), F.size("lines"), radius))
    cut = lambda w: F.array_join(F.slice(F.col("lines"), w["start"] + 1, w["end"] - w["start"] + 1), "\n")
    full = F.transform("w", lambda w: F.struct(w["start"].alias("start_line"), w["end"].alias("end_line"), w["anchors"].alias("anchors"), w["signals"].alias("signals"), cut(w).alias("source_text")))
    return wide.withColumn("windows", full).drop("w", "lines", "regions")


def context_windows(pages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row for every window."""
    rows = _each(with_windows(pages, radius), "windows", "w")
    return rows.select("document_id", "page_number", "w.start_line", "w.end_line", "w.anchors", "w.signals", "w.source_text", F.length("w.source_text").alias("char_count"))


def page_context(pages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each page's windows put together: text, anchors and signals in order of first sight, counts and ratio."""
    rows = with_windows(pages, radius)
    whole = F.when(F.col("has_text"), F.length("text")).otherwise(0)
    chosen = F.aggregate("windows", F.lit(0), lambda n, w: n + F.length(w["source_text"]))
    every = lambda f: F.array_distinct(F.flatten(F.transform("windows", lambda w: w[f])))
    return rows.select(
        *pages.columns,
        whole.alias("original_chars"),
        chosen.alias("selected_chars"),
        F.when(whole > 0, F.bround(chosen / whole, 4)).otherwise(0.0).alias("compression_ratio"),
        "windows",
        every("anchors").alias("anchors"),
        every("signals").alias("signals"),
        F.array_join(F.transform("windows", lambda w: w["source_text"]), JOINER).alias("combined_text"),
        (F.size("windows") == 0).alias("is_empty"),
    )


def prompt_text(context: DataFrame) -> DataFrame:
    """Contexts with ``prompt_text``: the windows, or the whole page where there are none."""
    return context.withColumn("prompt_text", F.when(F.col("is_empty"), F.coalesce("text", F.lit(""))).otherwise(F.col("combined_text")))


def radius_sweep(pages: DataFrame, radii: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """Character reduction by radius. Regions are found once; only widening and merging are repeated."""
    base = with_regions(pages.filter("has_text"))
    length = lambda w: F.aggregate(F.slice(F.col("lines"), w["start"] + 1, w["end"] - w["start"] + 1), F.lit(0), lambda n, x: n + F.length(x)) + w["end"] - w["start"]

    def one(radius: int) -> Column:
        spans = windows(F.col("regions"), F.size("lines"), radius)
        measured = F.transform(spans, length)
        return F.struct(F.lit(radius).alias("radius"), F.size(measured).alias("n"), F.aggregate(measured, F.lit(0), lambda n, x: n + x).alias("selected"))

    rows = base.select(F.length("text").alias("whole"), F.explode(F.array(*(one(r) for r in radii))).alias("r")).select("whole", "r.*")
    reduction = 1 - F.sum("selected") / F.sum("whole")
    return rows.groupBy("radius").agg(
        F.count("*").alias("n_pages"),
        F.sum("whole").alias("original_chars"),
        F.sum("selected").alias("selected_chars"),
        F.bround(100 * reduction, 2).alias("reduction_pct"),
        F.sum("n").alias("n_windows"),
        F.max("n").alias("max_windows"),
        F.percentile("n", F.lit(0.5)).alias("median_windows"),
    )


def gold_coverage(contexts: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """Whether each required element of gold facts is kept: any of its tokens occurs in the selected text.

    ``gold`` has the columns of ``on``, fact_id and elements (map of element to tokens; no tokens: kept).
    """
    text = F.lower(F.coalesce("combined_text", F.lit("")))
    kept = F.transform_values("elements", lambda k, ts: (F.size(ts) == 0) | F.exists(ts, lambda t: F.contains(text, F.lower(t))))
    hit = lambda k: F.coalesce(F.try_element_at("kept", F.lit(k)), F.lit(True))
    return gold.join(contexts.select(*on, "combined_text"), on, "left").withColumn("kept", kept).select(*on, "fact_id", "kept", (hit("value") & hit("metric")).alias("recalled"))

"""Pages: metadata, identity, relevance scores, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import vocab as V
from ..functions.text import blank, numbers, short_hash

THRESHOLD = 0.35
EXTRACTION_THRESHOLD = 0.30


def newline_clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def content_id(content: Column) -> Column:
    """The identity of a document's bytes."""
    return short_hash(content)


def with_metadata(pages: DataFrame) -> DataFrame:
    """char_count and has_text of pages (document_id, page_number, text)."""
    return pages.withColumns({"char_count": F.length("text"), "has_text": ~blank(F.col("text"))})


def page_signals(pages: DataFrame) -> DataFrame:
    """All signals of every page, as sorted distinct tokens and counts."""
    text, gate = F.coalesce(F.col("text"), F.lit("")), F.col("__gates")
    nums = S.page_numbers(text, gate)
    marked = pages.withColumn("__gates", S.gates(F.col("text"))).withColumns(
        {
            "n_numbers": F.size(nums),
            "sample_numbers": F.slice(nums, 1, 10),
            "currencies": S.currency(text, gate),
            "units": S.unit(text, gate),
            "metrics": S.metric(text, gate),
            "temporals": S.temporal(text, gate),
            "table_rows": S.table_rows(text, gate),
            "boilerplates": S.boilerplate(text, gate),
        }
    )
    return marked.drop("__gates")


def score_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Relevance of every page: score, selected, the triggered signals and what each adds.

    Neighbours are the pages before and after among those given. Scores are counted in hundredths, so
    they are exact. Signals are read before pages are brought to their neighbours; a caller that drops the
    text (or never asks for it) keeps it out of that shuffle.
    """
    order = Window.partitionBy("document_id").orderBy("page_number")
    near = lambda f: F.coalesce(f((F.size("metrics") > 0) & F.col("has_text")).over(order), F.lit(False))
    n, some = F.col("n_numbers"), lambda c: F.size(c) > 0
    points = {
        "numeric_density": F.least(5 * n, F.lit(30)),
        "currency": F.least(15 * F.size("currencies"), F.lit(25)),
        "unit": F.least(10 * F.size("units"), F.lit(20)),
        "metric": F.least(10 * F.size("metrics"), F.lit(25)),
        "table_structure": F.when(F.col("table_rows") >= 3, 15).otherwise(F.least(5 * F.col("table_rows"), F.lit(10))),
        "temporal": F.least(5 * F.size("temporals"), F.lit(10)),
        "neighbor_context": F.when((n >= 2) & ~some("metrics") & (F.col("__before") | F.col("__after")), 5).otherwise(0),
        "boilerplate_penalty": F.when(some("boilerplates") & ~some("currencies") & ~some("metrics") & (n <= 4), -30).otherwise(0),
    }
    marked = page_signals(pages).withColumns({"__before": near(F.lag), "__after": near(F.lead)})
    scored = marked.withColumn("__p", F.when(F.col("has_text"), F.struct(*(c.cast("int").alias(k) for k, c in points.items()))))
    total = F.greatest(F.lit(0), F.least(F.lit(100), sum((F.col(f"__p.{k}") for k in points), F.lit(0))))
    entries = F.array(*(F.struct(F.lit(k).alias("key"), (F.col(f"__p.{k}") / 100).alias("value")) for k in points))
    hundredths = F.coalesce(F.when(F.col("has_text"), total), F.lit(0))
    first = lambda c, k: F.array_join(F.slice(c, 1, k), ",")
    named = lambda test, name, inside=None: F.when(F.col("has_text") & test, F.lit(name) if inside is None else F.concat(F.lit(name + "("), inside, F.lit(")")))
    # Names of the signals and what is said of a page.
    triggered = F.array_compact(
        F.array(
            named(n > 0, "numeric_density", n.cast("string")),
            named(some("currencies"), "currency_indicator", first("currencies", 3)),
            named(some("units"), "quantitative_unit", first("units", 3)),
            named(some("metrics"), "metric_keyword", first("metrics", 3)),
            named(F.col("table_rows") > 0, "tabular_structure", F.concat(F.col("table_rows").cast("string"), F.lit("_rows"))),
            named(some("temporals"), "temporal_marker", first("temporals", 2)),
            named(F.col("__p.neighbor_context") > 0, "neighbor_metric_context"),
            named(F.col("__p.boilerplate_penalty") < 0, "boilerplate_penalty", first("boilerplates", 2)),
        )
    )
    why = F.when(~F.col("has_text"), "Page contains no extractable text content.").otherwise(
        F.concat(
            F.lit("Score: "),
            F.format_number(hundredths / 100, 3),
            F.lit(f" (Threshold: {threshold}); "),
            F.when(F.size(triggered) > 0, F.concat(F.lit("Signals: "), F.array_join(triggered, ", "))).otherwise("No quantitative signals identified."),
        )
    )
    return scored.select(
        *pages.columns,
        (hundredths / 100).alias("score"),
        (F.col("has_text") & (hundredths >= round(threshold * 100))).alias("selected"),
        F.coalesce(F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0)), F.create_map().cast("map<string,double>")).alias("breakdown"),
        triggered.alias("signals_triggered"),
        why.alias("explanation"),
    )


def select_pages(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pages whose score reaches the threshold, with all that ``score_pages`` adds; only scores meet neighbours."""
    added = ["score", "selected", "breakdown", "signals_triggered", "explanation"]
    found = score_pages(pages, threshold).filter("selected").select("document_id", "page_number", *added)
    return pages.join(found, ["document_id", "page_number"]).select(*pages.columns, *added)


def limit_pages(pages: DataFrame, numbers_: list[int] | None = None, first: int | None = None) -> DataFrame:
    """The pages of a given list of numbers, or the first few of each document, or all."""
    if numbers_:
        return pages.filter(F.col("page_number").isin(numbers_))
    if first:
        rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
        return pages.withColumn("__n", rank).filter(F.col("__n") <= first).drop("__n")
    return pages


def eligible_pages(pages: DataFrame, numbers_: list[int] | None = None, by_relevance: bool = True, threshold: float = EXTRACTION_THRESHOLD) -> DataFrame:
    """Pages worth extracting from: with text, then those asked for, or those relevant, or all."""
    full = pages.filter("has_text")
    if numbers_:
        return limit_pages(full, numbers_)
    return select_pages(full, threshold).select(*pages.columns) if by_relevance else full


def layout_blocks(texts: DataFrame, key: str) -> DataFrame:
    """Blocks of a text, separated by empty lines: a heading is a single line under 60 characters."""
    parts = F.filter(F.split(newline_clean(F.col("text")), r"\n[ \t]*\n\s*"), lambda x: ~blank(x))
    rows = texts.select(key, F.posexplode(parts).alias("block", "content"))
    is_heading = ~F.contains(F.trim("content"), F.lit("\n")) & (F.length(F.trim("content")) < 60)
    return rows.select(key, "block", F.when(is_heading, "heading").otherwise("paragraph").alias("block_type"), F.trim("content").alias("content"))


def page_complexity(pages: DataFrame) -> DataFrame:
    """Counts of numbers, percentages, currency expressions and table lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    wide = lambda x: (count(x, V.PLAIN_NUMBER) >= 3) | (F.contains(x, F.lit("\t")) & (count(x, V.PLAIN_NUMBER) >= 2))
    return pages.select(
        "document_id",
        "page_number",
        count(text, V.PLAIN_NUMBER).alias("n_numbers"),
        count(text, "(?i)" + V.PLAIN_PERCENT).alias("n_percents"),
        count(text, "(?i)" + V.PLAIN_CURRENCY).alias("n_currencies"),
        F.size(F.filter(F.split(text, "\n"), wide)).alias("n_table_lines"),
    )

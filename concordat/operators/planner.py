"""Batches of pages under a budget of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import durable
from .ranks import running_sums

BATCH_SIZE = 5


def plan_pages(eligible: DataFrame, budget: int | None = None, size: int = BATCH_SIZE, scored: bool = True) -> DataFrame:
    """document_id, page_number, n_eligible, planned and batch_id (from 0; null if deferred) of every page.

    Pages are distinct and from 1 on. A short budget takes the pages of the best scores (0.5 where a
    score is missing, smaller pages first), in the order of the document; without scores the first.

    No task sorts a document: the score at which the budget ends follows from the number of pages of each
    score, and which pages of that score are still taken, and a page's place among those planned, from running
    sums that are carried from one range of pages to the next.
    """
    size = size if size > 0 else BATCH_SIZE
    best = scored and "score" in eligible.columns
    score = F.coalesce(F.max("score"), F.lit(0.5)) if best else F.lit(0.0)
    pages = durable(eligible.filter("page_number >= 1").groupBy("document_id", "page_number").agg(score.alias("s")))
    unbounded = budget is None or budget <= 0
    levels = pages.groupBy("document_id", "s").agg(F.count("*").alias("c"))
    down = Window.partitionBy("document_id").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    room = F.lit(None).cast("long") if unbounded else F.lit(budget * size).cast("long")
    ends = levels.withColumn("upto", F.sum("c").over(down)).groupBy("document_id").agg(
        F.sum("c").alias("n_eligible"),
        # The first score by which the budget is reached, and how many of its pages are still taken.
        F.max(F.when(F.col("upto") >= room, F.struct("s", (room - F.col("upto") + F.col("c")).alias("left")))).alias("end"),
    )
    ends = ends.select(F.col("document_id").alias("__of"), "n_eligible", "end")
    placed = pages.join(ends, F.col("document_id").eqNullSafe(F.col("__of"))).drop("__of")
    over = F.col("end").isNull() | (F.col("s") > F.col("end.s"))
    tied = F.col("end").isNotNull() & (F.col("s") == F.col("end.s"))
    sums = running_sums(placed, ["document_id"], "page_number", {"n_over": over.cast("int"), "n_tied": tied.cast("int")})
    planned = over | (tied & (F.col("n_tied") <= F.col("end.left")))
    place = F.col("n_over") + F.least(F.col("n_tied"), F.coalesce("end.left", F.lit(0))) - 1
    out = sums.withColumns({"planned": planned, "place": place})
    return out.select("document_id", "page_number", F.col("n_eligible"), "planned", F.when(F.col("planned"), F.floor(F.col("place") / size)).cast("int").alias("batch_id"))


def plan_summary(plan: DataFrame, budget: int | None = None, size: int = BATCH_SIZE) -> DataFrame:
    """One row for each document with pages: requests needed and planned, whether the budget suffices, what is left."""
    needed = F.ceil(F.col("n_eligible") / size)
    rows = plan.groupBy("document_id").agg(F.max("n_eligible").alias("n_eligible"), F.sum(F.col("planned").cast("int")).alias("n_planned"))
    requests = F.ceil(F.col("n_planned") / size)
    return rows.select(
        "document_id",
        "n_eligible",
        "n_planned",
        (F.col("n_eligible") - F.col("n_planned")).alias("n_deferred"),
        needed.alias("estimated_requests"),
        requests.alias("planned_requests"),
        (F.lit(budget is None or budget <= 0) | (needed <= F.lit(budget or 0))).alias("can_complete"),
        (F.lit(budget).cast("long") - requests).alias("remaining_budget"),
    )


def batch_prompts(plan: DataFrame, texts: DataFrame, document_date: str | None = None) -> DataFrame:
    """The prompt of every batch. ``texts``: document_id, page_number and prompt_text."""
    from ..functions.text import strip

    rows = plan.filter("planned").join(texts.select("document_id", "page_number", "prompt_text"), ["document_id", "page_number"])
    pages = F.array_sort(F.collect_list(F.struct("page_number", strip(F.coalesce("prompt_text", F.lit(""))).alias("t"))))
    batches = rows.groupBy("document_id", "batch_id").agg(pages.alias("pages"))
    number = lambda p: p["page_number"].cast("string")
    section = lambda p: F.concat(F.lit("===== DOCUMENT PAGE "), number(p), F.lit(" START =====\n"), p["t"], F.lit("\n===== DOCUMENT PAGE "), number(p), F.lit(" END =====\n"))
    # The wording of a prompt.
    prompt = F.concat(
        F.lit("Document: "),
        F.col("document_id"),
        F.lit(f"\nDocument Date: {document_date or 'Unknown'}\nPages in this batch: "),
        F.array_join(F.transform("pages", number), ", "),
        F.lit("\n\nExtract all facts and assign each fact strictly to its source page_number.\n\n"),
        F.array_join(F.transform("pages", section), "\n"),
    )
    return batches.select("document_id", "batch_id", F.size("pages").alias("n_pages"), prompt.alias("prompt"))


def batch_payload(plan: DataFrame, contexts: DataFrame) -> DataFrame:
    """Windows and characters of every batch, before and after selection. ``contexts``: prompt texts of pages."""
    rows = plan.filter("planned").join(contexts, ["document_id", "page_number"])
    sizes = F.flatten(F.collect_list(F.transform("windows", lambda w: F.length(w["source_text"]))))
    out = rows.groupBy("document_id", "batch_id").agg(
        F.count("*").alias("n_pages"),
        F.sum(F.length(F.coalesce("text", F.lit("")))).alias("raw_chars"),
        F.sum(F.length("prompt_text")).alias("compressed_chars"),
        sizes.alias("sizes"),
    )
    total = F.aggregate("sizes", F.lit(0), lambda a, x: a + x)
    return out.select(
        "document_id",
        "batch_id",
        "n_pages",
        F.size("sizes").alias("n_windows"),
        F.when(F.size("sizes") > 0, F.bround(total / F.size("sizes"), 1)).otherwise(0.0).alias("avg_window"),
        F.coalesce(F.array_max("sizes"), F.lit(0)).alias("max_window"),
        "raw_chars",
        "compressed_chars",
        F.when(F.col("raw_chars") > 0, F.bround(F.col("compressed_chars") / F.col("raw_chars"), 3)).otherwise(1.0).alias("compression_ratio"),
    )


def _literals(spark: SparkSession, name: str, values: Sequence[int]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(v) for v in values))).alias(name))


def batch_sweep(contexts: DataFrame, sizes: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """Requests and payload for each batch size, over all documents; ``contexts`` as of ``page_context``."""
    docs = contexts.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("original_chars").alias("raw"), F.sum("selected_chars").alias("kept"))
    rows = docs.crossJoin(F.broadcast(_literals(docs.sparkSession, "batch_size", sizes)))  # a handful of literals
    out = rows.groupBy("batch_size").agg(F.sum("n").alias("total_pages"), F.sum(F.ceil(F.col("n") / F.col("batch_size"))).alias("requests"), F.sum("raw").alias("raw_chars"), F.sum("kept").alias("selected_chars"))
    return out.withColumns(
        {
            "request_reduction_pct": F.bround(100 * (1 - F.col("requests") / F.col("total_pages")), 2),
            "char_reduction_pct": F.bround(100 * (1 - F.col("selected_chars") / F.col("raw_chars")), 2),
        }
    )


def budget_simulation(eligible: DataFrame, budgets: Sequence[int] = (10, 20, 50, 100), sizes: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """What each budget and batch size covers of all eligible pages."""
    spark = eligible.sparkSession
    n = eligible.agg(F.count("*").alias("n_eligible"))
    grid = n.crossJoin(_literals(spark, "budget", budgets)).crossJoin(_literals(spark, "batch_size", sizes))  # one row and literals
    able = F.least("n_eligible", F.col("budget") * F.col("batch_size"))
    return grid.select(
        "budget",
        "batch_size",
        F.ceil(F.col("n_eligible") / F.col("batch_size")).alias("requests_needed"),
        able.alias("processable_pages"),
        (F.col("n_eligible") - able).alias("deferred_pages"),
        F.when(F.col("n_eligible") > 0, F.bround(100 * able / F.col("n_eligible"), 1)).otherwise(100.0).alias("coverage_pct"),
        F.when(able == F.col("n_eligible"), "COMPLETE").otherwise("PARTIAL_QUOTA").alias("status"),
    )


def size_projection(documents: DataFrame, sizes: Sequence[int] = (1, 2, 3, 5), density_pct: int = 60) -> DataFrame:
    """Requests for documents (document_id, total_pages) of which a share of the pages has facts."""
    grid = documents.select("document_id", "total_pages", F.explode(F.array(*(F.lit(v) for v in sizes))).alias("batch_size"))
    eligible = F.floor(F.col("total_pages") * density_pct / 100)
    requests = F.ceil(eligible / F.col("batch_size"))
    return grid.select("document_id", "total_pages", "batch_size", eligible.alias("eligible_pages"), requests.alias("requests"), F.bround(100 * (1 - requests / F.col("total_pages")), 1).alias("reduction_pct"), (eligible - requests).alias("saved_requests"))


def latency_projection(spark: SparkSession, mean_latency: DataFrame, milestones: Sequence[int] = (50, 100, 184, 300, 500)) -> DataFrame:
    """Projected seconds; ``mean_latency``: batch_size and mean_ms (whole milliseconds)."""
    rows = mean_latency.crossJoin(F.broadcast(_literals(spark, "pages", milestones)))
    requests = F.ceil(F.col("pages") / F.col("batch_size"))
    return rows.select("batch_size", "pages", requests.alias("requests"), (requests * F.col("mean_ms")).alias("projected_ms"))

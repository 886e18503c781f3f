"""From lines or model output to claims grounded on their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import collapse, lines, short_hash, strip
from ..shared import durable
from ..shipping import ship
from .journal import Journal, fingerprint

#: The schema that model output is read by.
CANDIDATES = (
    "facts array<struct<page_number:int,entity:string,metric:string,value_raw:string,value_numeric:string,unit:string,"
    "time_period:struct<label:string,start_date:string,end_date:string>,scope:string,geography:string,epistemic_status:string,"
    "data_vintage:string,supporting_text:string,extraction_confidence:string>>"
)


def _ladder(text: Column, steps: Iterable[tuple[tuple[str, ...], str]], default: str | None) -> Column:
    """The value of the first step of which the text holds any word."""
    out = None
    for words, value in steps:
        test = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            test = test | F.contains(text, F.lit(w))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.lit(default))


def epistemic_label(text: Column) -> Column:
    return _ladder(F.lower(text), V.RULE_STATUS, "Reported Fact")


def epistemic_status(label: Column) -> Column:
    return _ladder(F.lower(F.coalesce(label, F.lit(""))), V.STATUS_WORDS, "reported")


def numeric_candidate(raw: Column) -> Column:
    """The number that is left of a raw value without symbols and unit words; null if none is."""
    x = F.regexp_replace(raw, r"₹|\$|Rs\.|INR|USD|[><~%]", "")
    x = F.regexp_replace(strip(x), r"(?i)\b(?:Cr(?:ore)?|Mn|Million|Bn|Billion|Lakh|tonnes?|shipments?|customers?)\b", "")
    return strip(F.replace(x, F.lit(","), F.lit(""))).try_cast("double")


def fact_id(document: Column, page: Column, entity: Column, metric: Column, value: Column, label: Column) -> Column:
    text = lambda c: strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(F.lit("fact-"), short_hash(F.concat_ws("|", document, page.cast("string"), text(entity), text(metric), text(value), text(label))))


def line_values(line: Column) -> Column:
    """The distinct values of a line: money, percentages, bounds, then counts that no earlier value holds."""
    every = lambda p, g=0: F.regexp_extract_all(line, F.lit("(?i)" + p), F.lit(g))
    long = lambda xs: F.filter(F.transform(xs, strip), lambda x: F.length(x) > 1)
    bounds = F.zip_with(every(V.RULE_BOUND, 1), every(V.RULE_BOUND, 2), lambda a, b: F.concat(a, b))
    first = F.array_distinct(F.concat(long(every(V.RULE_MONEY)), F.transform(every(V.RULE_PERCENT), strip), long(bounds)))
    add = lambda acc, x: F.when(F.exists(acc, lambda y: F.contains(y, x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.transform(every(V.RULE_COUNT, 1), strip), first, add)


def rule_claims(pages: DataFrame) -> DataFrame:
    """Claims read off lines by patterns and keyword ladders, one for each value of a line."""
    return name_claims(read_lines(pages))


def name_claims(claims: DataFrame) -> DataFrame:
    own = fact_id(*(F.col(c) for c in ("document_id", "page_number", "entity", "metric", "value_raw", "period_label")))
    return claims.withColumn("fact_id", own)


def read_lines(pages: DataFrame) -> DataFrame:
    """Claims of pages that have no ``fact_id`` yet."""
    able = lambda x: F.length(strip(x)) > 3
    digits = lambda x: F.regexp_like(x, F.lit("[0-9,]"))  # noqa: E731  no value without
    rows = pages.select("document_id", "page_number", F.posexplode(F.filter(F.filter(lines(F.col("text")), able), digits)).alias("segment", "raw"))
    rows = rows.select("document_id", "page_number", "segment", strip(F.col("raw")).alias("supporting_text"))
    rows = rows.withColumn("low", F.lower("supporting_text")).select("*", F.posexplode(line_values(F.col("supporting_text"))).alias("value_no", "value_raw"))
    has = lambda c, *ws: F.greatest(*(F.contains(c, F.lit(w)) for w in ws), F.lit(False))
    v, low = F.col("value_raw"), F.lower("value_raw")
    unit = (
        F.when(has(v, "₹", "INR", "Rs") | has(low, "million", "cr"), "INR")
        .when(has(v, "%"), "percent")
        .when(has(low, "tonnes"), "tonnes")
        .when(has(low, "shipments"), "shipments")
        .when(has(low, "customers"), "customers")
        .when(has(low, "pin"), "pin codes")
    )
    fiscal = F.regexp_extract("supporting_text", "(?i)" + V.RULE_FISCAL, 1)
    label = F.coalesce(F.nullif(strip(fiscal), F.lit("")), F.nullif(F.regexp_extract("supporting_text", V.RULE_CALENDAR, 1), F.lit("")), F.lit(V.NO_PERIOD))
    return rows.select(
        "document_id",
        "page_number",
        "segment",
        "value_no",
        _ladder(F.col("low"), V.RULE_ENTITIES, V.NO_ENTITY).alias("entity"),
        _ladder(F.col("low"), V.RULE_METRICS, V.NO_METRIC).alias("metric"),
        "value_raw",
        numeric_candidate(v).alias("value_numeric"),
        unit.alias("unit"),
        label.alias("period_label"),
        F.when(has(F.col("low"), "consolidated"), "Consolidated").alias("scope"),
        F.when(has(F.col("low"), "india"), "India").alias("geography"),
        epistemic_status(epistemic_label(F.col("supporting_text"))).alias("epistemic_status"),
        F.lit(None).cast("string").alias("data_vintage"),
        "supporting_text",
        F.lit(0.88).alias("extraction_confidence"),
    )


def grounded(target: Column, page_text: Column) -> Column:
    """Whether a text stands on a page, as it is or with white space collapsed on both sides."""
    t, p = strip(F.coalesce(target, F.lit(""))), F.coalesce(page_text, F.lit(""))
    return (t != "") & (F.contains(p, t) | F.contains(collapse(p), collapse(t)))


def with_grounding(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Claims with ``is_grounded`` and ``is_exact``: whether the supporting text stands on the cited page."""
    rows = claims.join(pages.select("document_id", "page_number", F.col("text").alias("__page")), ["document_id", "page_number"], "left")
    t = strip(F.coalesce("supporting_text", F.lit("")))
    exact = (t != "") & F.contains(F.coalesce("__page", F.lit("")), t)
    return rows.withColumns({"is_grounded": grounded(F.col("supporting_text"), F.col("__page")), "is_exact": exact}).drop("__page")


#: Bits of a page's set of words.
WORD_BITS = 4_096


def _words(text: Column) -> Column:
    return F.split(strip(F.coalesce(text, F.lit(""))), V.SPACE + "+")


def _word_bits(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(WORD_BITS)).cast("int")))


def page_filters(pages: DataFrame) -> DataFrame:
    """document_id, page_number and ``bits``: a Bloom filter of each page's words, as 62-bit numbers by their place."""
    rows = pages.select("document_id", "page_number", F.array_sort(_word_bits(_words(F.col("text")))).alias("b"))
    kind = "struct<done:array<struct<k:int,w:bigint>>,k:int,w:bigint>"
    start = F.struct(F.array().cast("array<struct<k:int,w:bigint>>").alias("done"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("w"))
    entry = lambda acc: F.array(F.struct(acc["k"].alias("k"), acc["w"].alias("w")))

    def add(acc: Column, x: Column) -> Column:
        """The bits are sorted, so that a number is done when the next one begins."""
        k, bit = F.floor(x / 62).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (x % 62).cast("int"))
        more = F.struct(acc["done"].alias("done"), k.alias("k"), acc["w"].bitwiseOR(bit).alias("w"))
        fresh = F.struct(F.concat(acc["done"], entry(acc)).alias("done"), k.alias("k"), bit.alias("w"))
        return F.when(acc["k"] == k, more).otherwise(fresh).cast(kind)

    words = F.aggregate("b", start.cast(kind), add, lambda acc: F.map_from_entries(F.concat(acc["done"], entry(acc))))
    return rows.select("document_id", "page_number", words.alias("bits"))


def with_contamination(claims: DataFrame, pages: DataFrame, batches: DataFrame) -> DataFrame:
    """Claims with ``is_contaminated``: not on the cited page, but on another page of its batch.

    A text that stands on a page has all of its words there but the first and last, which may be cut off. So a
    claim meets its batch's pages by Bloom filters of their words, half a kilobyte each, and only pages that can
    hold it are fetched with their texts.
    """
    own = with_grounding(claims, pages)
    filters = batches.join(page_filters(pages), ["document_id", "page_number"])
    others = filters.select("document_id", "batch_id", F.col("page_number").alias("__other"), "bits")
    lost = durable(own.filter(~F.col("is_grounded") & (strip(F.coalesce("supporting_text", F.lit(""))) != "")).select("pos", "document_id", "page_number", "supporting_text"))
    inner = _words(F.col("supporting_text"))
    asked = lost.join(batches, ["document_id", "page_number"]).select("pos", "document_id", "batch_id", "page_number", _word_bits(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))).alias("__asked"))
    has = lambda x: F.coalesce(F.call_function("shiftright", F.try_element_at("bits", F.floor(x / 62).cast("int")), (x % 62).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    able = asked.join(others, ["document_id", "batch_id"]).filter((F.col("__other") != F.col("page_number")) & F.forall("__asked", has))
    texts = pages.select("document_id", F.col("page_number").alias("__other"), F.col("text").alias("__text"))
    met = able.select("pos", "document_id", "__other").join(texts, ["document_id", "__other"]).join(lost.select("pos", "supporting_text"), "pos")
    found = met.filter(grounded(F.col("supporting_text"), F.col("__text"))).select("pos").distinct().withColumn("__hit", F.lit(True))
    return own.join(found, "pos", "left").withColumn("is_contaminated", F.coalesce("__hit", F.lit(False))).drop("__hit")


def with_duplicates(claims: DataFrame) -> DataFrame:
    """Claims with ``is_duplicate``: an earlier one has the same fact_id."""
    rank = F.row_number().over(Window.partitionBy("fact_id").orderBy("pos"))
    return claims.withColumn("is_duplicate", rank > 1)


def reject_reason(claims: DataFrame, batches: DataFrame) -> DataFrame:
    """Claims with ``reject_reason`` (null: accepted): page outside of the batch, an empty field, or no grounding."""
    empty = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    known = batches.select("document_id", "page_number", F.lit(True).alias("__in"))
    rows = claims.join(known, ["document_id", "page_number"], "left")
    lacking = empty(F.col("entity")) | empty(F.col("metric")) | empty(F.col("value_raw")) | empty(F.col("supporting_text"))
    reason = F.when(F.col("__in").isNull(), "page_outside_batch").when(lacking, "missing_field").when(~F.col("is_grounded"), "not_grounded")
    return rows.withColumn("reject_reason", reason).drop("__in")


def evidence(document: Column, page: Column, text: Column, date: Column | None = None) -> Column:
    """A reference to a text on a page; pages are numbered from 1, and any other number raises an error."""
    bad = F.raise_error(F.concat(F.lit("page_number must be >= 1 (1-indexed), got "), F.coalesce(page.cast("string"), F.lit("null"))))
    number = F.when(page >= 1, page).otherwise(bad.cast("int"))
    return F.struct(document.alias("document_id"), (F.lit(None).cast("string") if date is None else date).alias("document_date"), number.alias("page_number"), text.alias("supporting_text"))


def read_candidates(raw: DataFrame, lenient: bool = False) -> DataFrame:
    """Claims of model output (document_id, batch_id, output as JSON), with types coerced and defaults set.

    ``lenient`` output may lack an entity or metric, which is then ``Unknown``, and has no data vintage.
    """
    rows = raw.select("document_id", "batch_id", F.posexplode(F.from_json("output", CANDIDATES)["facts"]).alias("candidate_no", "f"))
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    some = lambda c: F.nullif(text(c), F.lit(""))
    named = lambda c: F.coalesce(some(c), F.lit("Unknown")) if lenient else text(c)
    status = F.lower(text("f.epistemic_status"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("f.extraction_confidence").try_cast("double"), F.lit(0.0))))
    out = rows.select(
        "document_id",
        "batch_id",
        "candidate_no",
        F.col("f.page_number").alias("page_number"),
        named("f.entity").alias("entity"),
        named("f.metric").alias("metric"),
        text("f.value_raw").alias("value_raw"),
        F.col("f.value_numeric").try_cast("double").alias("value_numeric"),
        some("f.unit").alias("unit"),
        F.coalesce(some("f.time_period.label"), F.lit("Unspecified")).alias("period_label"),
        F.col("f.time_period.start_date").alias("period_start"),
        F.col("f.time_period.end_date").alias("period_end"),
        some("f.scope").alias("scope"),
        some("f.geography").alias("geography"),
        F.when(status.isin(*V.EPISTEMIC), status).otherwise("reported").alias("epistemic_status"),
        (F.lit(None).cast("string") if lenient else some("f.data_vintage")).alias("data_vintage"),
        text("f.supporting_text").alias("supporting_text"),
        confidence.alias("extraction_confidence"),
    )
    return out.withColumn("fact_id", fact_id(*(F.col(c) for c in ("document_id", "page_number", "entity", "metric", "value_raw", "period_label"))))


class QuotaExhausted(Exception):
    """Raised by a model's caller where its quota is used up."""


def call_model(prompts: DataFrame, caller: Callable[[str], str], partitions: int = 2, attempts: int = 3, journal: Journal | None = None, stop_at_quota: bool = True) -> DataFrame:
    """document_id, batch_id, outcome, output and error of a model called for each prompt, by at most ``partitions`` at a time.

    ``caller`` takes a prompt and returns JSON. A document's batches run in order up to the first that fails, with
    outcome ``quota`` (``QuotaExhausted``) or ``error``; those after it are ``skipped`` and cost no call. A
    ``ConnectionError`` is tried again, after one and two seconds. After an end of quota no further call is made
    in that partition (with ``stop_at_quota``), and with a journal in none: the documents' next batches have the
    outcome ``quota`` too. Answers in the journal are not asked for again, also where a task is run again.
    """
    import pandas as pd

    def ask(document: str, prompt: str) -> tuple[str, str | None, str | None]:
        import time

        key = fingerprint(document, prompt)
        if journal is not None and (known := journal.answer(key)) is not None:
            return "ok", known, None
        if journal is not None and stop_at_quota and (why := journal.stopped()) is not None:
            return "quota", None, why
        for k in range(attempts):
            try:
                output = caller(prompt)
            except QuotaExhausted as e:
                why = f"{type(e).__name__}: {e}"
                if journal is not None:
                    journal.stop(why)
                return "quota", None, why
            except Exception as e:  # noqa: BLE001  kept with the batch, as the caller may raise anything
                if not isinstance(e, ConnectionError) or k + 1 == attempts:
                    return "error", None, f"{type(e).__name__}: {e}"
                time.sleep(2**k)
            else:
                if journal is not None:
                    journal.keep(key, output)
                return "ok", output, None
        raise ValueError("attempts must be positive")

    def run(batches):
        stopped, ended = None, None  # the document whose batches are skipped; why no more calls are made
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                if r.document_id == stopped:
                    outcome, output, error = "skipped", None, None
                elif ended is not None:
                    known = journal.answer(fingerprint(r.document_id, r.prompt)) if journal is not None else None
                    outcome, output, error = ("ok", known, None) if known is not None else ("quota", None, ended)
                else:
                    outcome, output, error = ask(r.document_id, r.prompt)
                if outcome != "ok":
                    stopped = r.document_id
                if outcome == "quota" and stop_at_quota:
                    ended = error
                rows.append((r.document_id, r.batch_id, outcome, output, error))
            yield pd.DataFrame(rows, columns=["document_id", "batch_id", "outcome", "output", "error"])

    ship(prompts.sparkSession)
    dealt = prompts.select("document_id", "batch_id", "prompt").repartition(partitions, "document_id").sortWithinPartitions("document_id", "batch_id")
    return dealt.mapInPandas(run, "document_id string, batch_id int, outcome string, output string, error string")


def extraction_status(batches: DataFrame, plan: DataFrame) -> DataFrame:
    """Status of each document from its batches' outcomes (ok, quota or error), run in order up to the first failure.

    ``batches``: document_id, batch_id, outcome. ``plan``: as of ``plan_pages``.
    """
    failed = batches.filter("outcome <> 'ok'").groupBy("document_id").agg(F.min(F.struct("batch_id", "outcome")).alias("stop"))
    pages = plan.join(failed, "document_id", "left")
    done = F.col("planned") & (F.col("stop").isNull() | (F.col("batch_id") < F.col("stop.batch_id")))
    rows = pages.groupBy("document_id").agg(
        F.max("n_eligible").alias("n_eligible"),
        F.sum(done.cast("int")).alias("n_processed"),
        F.count_distinct(F.when(done, F.col("batch_id"))).alias("requests_used"),
        F.max("stop.outcome").alias("stopped_by"),
    )
    left = F.col("n_eligible") - F.col("n_processed")
    status = (
        F.when(F.col("stopped_by") == "quota", F.when(F.col("n_processed") == 0, "QUOTA_EXHAUSTED").otherwise("PARTIAL_QUOTA"))
        .when(F.col("stopped_by").isNotNull(), "FAILED")
        .when(left > 0, "PARTIAL_QUOTA")
        .otherwise("COMPLETE")
    )
    return rows.select("document_id", "n_eligible", "n_processed", left.alias("n_unprocessed"), "requests_used", status.alias("status"))


def overall_status(statuses: DataFrame, order: Column | str = "document_id") -> DataFrame:
    """Sums over documents and the status of all: failed if any is, else the last that is not complete.

    ``order`` is what documents follow one another by, as the names of their files.
    """
    last = F.max_by("status", F.when(F.col("status") != "COMPLETE", F.col(order) if isinstance(order, str) else order))
    return statuses.agg(
        F.count("*").alias("n_documents"),
        F.sum("n_eligible").alias("n_eligible"),
        F.sum("n_processed").alias("n_processed"),
        F.sum("n_unprocessed").alias("n_unprocessed"),
        F.sum("requests_used").alias("requests_used"),
        F.when(F.bool_or(F.col("status") == "FAILED"), "FAILED").otherwise(F.coalesce(last, F.lit("COMPLETE"))).alias("status"),
    )


#: What is told of a document by its status.
STATUS_MESSAGES = {
    "COMPLETE": "Extraction completed successfully for all eligible pages.",
    "PARTIAL_QUOTA": "Extraction partially completed within the quota limit; some eligible pages were left out.",
    "QUOTA_EXHAUSTED": "The quota limit was reached before any page was processed.",
    "FAILED": "Extraction failed at an error.",
}


def document_summaries(statuses: DataFrame, claims: DataFrame, batches: DataFrame, budget: int | None = None) -> DataFrame:
    """Statuses with each document's requests_available, facts_extracted, facts_rejected_grounding, user_message and error_message.

    ``claims``: with their reject_reason; ``batches``: with outcomes and errors.
    """
    counts = claims.groupBy("document_id").agg(F.count_if(F.col("reject_reason").isNull()).alias("facts_extracted"), F.count_if(F.col("reject_reason") == "not_grounded").alias("facts_rejected_grounding"))
    errors = batches.filter("error IS NOT NULL").groupBy("document_id").agg(F.min_by("error", "batch_id").alias("error_message"))
    rows = statuses.join(counts, "document_id", "left").join(errors, "document_id", "left")
    said = F.create_map(*(F.lit(x) for pair in STATUS_MESSAGES.items() for x in pair))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    left = F.greatest(F.lit(budget).cast("long") - F.col("requests_used"), F.lit(0)).alias("requests_available")
    return rows.select(*statuses.columns, left, none("facts_extracted"), none("facts_rejected_grounding"), said[F.col("status")].alias("user_message"), "error_message")


def unprocessed_pages(plan: DataFrame, processed: DataFrame) -> DataFrame:
    return plan.select("document_id", "page_number").join(processed, ["document_id", "page_number"], "left_anti")

"""Logs of model providers: failure classes, rate limits, run totals, metrics in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status codes and the class of failure each stands for.
FAILURES = {400: "400_REQUEST_SCHEMA", 401: "401_403_AUTH_PERMISSION", 403: "401_403_AUTH_PERMISSION", 404: "404_MODEL_NOT_FOUND", 408: "408_TIMEOUT", 429: "429_QUOTA_RATE_LIMIT"}
SERVER, PARSE, UNKNOWN = "5XX_SERVER_ERROR", "STRUCTURED_OUTPUT_PARSE_ERROR", "UNKNOWN_ERROR"
LIMITS = ("limit_requests", "limit_tokens", "remaining_requests", "remaining_tokens", "reset_requests", "reset_tokens")


def failure_class(status: Column, parsed: Column) -> Column:
    """The class of a response's failure; null for a success whose body could be parsed; no status is a timeout."""
    out = F.when(status.isNull(), FAILURES[408]).when((status == 200) & parsed, None).when(status == 200, PARSE)
    for code, name in FAILURES.items():
        out = out.when(status == code, name)
    return out.when(status >= 500, SERVER).otherwise(UNKNOWN)


def rate_limits(headers: Column) -> Column:
    """The rate-limit headers of a response as a struct, with all of them in ``raw``; names without regard to case."""
    low = F.transform_keys(headers, lambda k, v: F.lower(k))
    one = lambda name: F.try_element_at(low, F.lit("x-ratelimit-" + name.replace("_", "-"))).alias(name)
    return F.struct(*(one(n) for n in LIMITS), F.map_filter(low, lambda k, v: F.startswith(k, F.lit("x-ratelimit"))).alias("raw"))


def run_totals(requests: DataFrame) -> DataFrame:
    """Requests by run: succeeded, failed, of these 429 and 503, and retries. ``requests``: run_id, status, retries."""
    ok = F.col("status") == 200
    return requests.groupBy("run_id").agg(
        F.count("*").alias("n_requests"),
        F.count_if(ok).alias("n_ok"),
        F.count_if(~ok).alias("n_failed"),
        F.count_if(F.col("status") == 429).alias("n_429"),
        F.count_if(F.col("status") == 503).alias("n_503"),
        F.sum("retries").alias("n_retries"),
    )


def entities_by_type(predictions: DataFrame, key: str) -> DataFrame:
    """Predicted spans of a segment by label, in order of position. ``predictions``: key, label, start, text."""
    listed = F.array_sort(F.collect_list(F.struct("start", "text")))
    rows = predictions.groupBy(key, "label").agg(F.transform(listed, lambda x: x["text"]).alias("texts"))
    return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "texts")))).alias("entities"))


def long_metrics(summary: DataFrame, key: str, derived: tuple[str, ...] = (), absent: tuple[str, ...] = ()) -> DataFrame:
    """A summary's columns as rows: metric, value and whether it is measured, derived or not available."""
    names = [c for c in summary.columns if c != key]
    kind = lambda c: "DERIVED" if c in derived else "MEASURED"
    own = [F.struct(F.lit(c).alias("metric"), F.lit(kind(c)).alias("classification"), F.col(c).cast("double").alias("value")) for c in names]
    none = [F.struct(F.lit(c).alias("metric"), F.lit("N/A").alias("classification"), F.lit(None).cast("double").alias("value")) for c in absent]
    return summary.select(key, F.explode(F.array(*own, *none)).alias("m")).select(key, "m.*")

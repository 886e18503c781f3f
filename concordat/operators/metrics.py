"""Summaries: quality, latency, failures, sweeps, set algebra of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.text import strip
from ..shared import durable
from .ranks import median, middle_ranks, values_at


def quality_metrics(claims: DataFrame, n_candidates: Column | None = None) -> DataFrame:
    """Grounding, attribution, duplicates and presence of fields. ``claims``: as of ``with_grounding``."""
    kept = F.col("is_grounded")
    key = F.struct(*(F.lower(strip(F.coalesce(c, F.lit("")))) for c in ("entity", "metric", "period_label")))
    n = F.count_if(kept)
    some = lambda c: kept & (F.length(strip(F.coalesce(c, F.lit("")))) > 1)
    counts = claims.agg(
        F.count("*").alias("n_candidates"),
        n.alias("n_verified"),
        F.count_if(kept & F.col("is_exact")).alias("n_attributed"),
        (n - F.count_distinct(F.when(kept, key))).alias("n_duplicates"),
        F.count_if(some("entity")).alias("n_entity"),
        F.count_if(some("metric")).alias("n_metric"),
        F.count_if(kept & (F.col("value_numeric").isNotNull() | (F.coalesce("value_raw", F.lit("")) != ""))).alias("n_value"),
        F.count_if(kept & (F.coalesce("period_label", F.lit("")) != "")).alias("n_period"),
    )
    rate = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(empty))
    return counts.select(
        "n_candidates",
        "n_verified",
        rate("n_verified", "n_candidates", 1.0).alias("grounding_rate"),
        rate("n_attributed", "n_verified", 1.0).alias("attribution_rate"),
        "n_duplicates",
        rate("n_duplicates", "n_verified", 0.0).alias("duplicate_rate"),
        rate("n_entity", "n_verified", 1.0).alias("entity_rate"),
        rate("n_metric", "n_verified", 1.0).alias("metric_rate"),
        rate("n_value", "n_verified", 1.0).alias("value_rate"),
        rate("n_period", "n_verified", 1.0).alias("period_rate"),
    )


def threshold_sweep(scored: DataFrame, thresholds: Sequence[int] = (20, 30, 35, 40, 50, 60, 70)) -> DataFrame:
    """Confusion counts, recall and precision for each threshold (in hundredths). ``scored``: score and truth."""
    steps = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    hit = F.round(F.col("score") * 100).cast("int") >= F.col("threshold")
    rows = scored.select("score", "truth", steps).groupBy("threshold").agg(
        F.count_if(F.col("truth") & hit).alias("tp"),
        F.count_if(~F.col("truth") & hit).alias("fp"),
        F.count_if(F.col("truth") & ~hit).alias("fn"),
        F.count_if(~F.col("truth") & ~hit).alias("tn"),
    )
    pct = lambda a, b: F.when(b > 0, F.bround(100 * a / b, 1)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.select("threshold", "tp", "fp", "fn", "tn", pct(tp, tp + fn).alias("recall_pct"), pct(tp, tp + fp).alias("precision_pct"), pct(fn + tn, tp + fp + fn + tn).alias("reduction_pct"))


def corpus_rollup(scored: DataFrame) -> DataFrame:
    """Pages, text pages and selected pages by document, and for all (document_id null)."""
    out = scored.rollup("document_id").agg(F.count("*").alias("n_pages"), F.count_if("has_text").alias("n_text"), F.count_if("selected").alias("n_selected"))
    return out.withColumn("reduction_pct", F.when(F.col("n_text") > 0, F.bround(100 * (F.col("n_text") - F.col("n_selected")) / F.col("n_text"), 1)).otherwise(0.0))


def recall_precision(found: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """How many of the gold facts are found, and of the found ones gold."""
    f = found.select(*on).distinct().withColumn("f", F.lit(1))
    g = gold.select(*on).distinct().withColumn("g", F.lit(1))
    n = f.join(g, on, "full").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("n_matched"))
    pct = lambda b: F.when(F.col(b) > 0, F.bround(100 * F.col("n_matched") / F.col(b), 2)).otherwise(0.0)
    return n.select("*", pct("n_gold").alias("recall_pct"), pct("n_found").alias("precision_pct"))


def _latency_counts(requests: DataFrame, by: str, ok: str) -> DataFrame:
    return requests.groupBy(by).agg(
        F.count("*").alias("n_requests"),
        F.count_if(F.col("outcome") == ok).alias("n_ok"),
        F.count_if(F.col("outcome") != ok).alias("n_failed"),
        F.avg("latency_ms").alias("mean_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.min("latency_ms").alias("min_ms"),
    )


def latency_stats(requests: DataFrame, by: str = "batch_id", ok: str = "view") -> DataFrame:
    """Counts and latencies (in whole milliseconds) by batch; medians are found by counting."""
    at = values_at(requests, by, "latency_ms", middle_ranks()).select(by, median().alias("median_ms"))
    return _latency_counts(requests, by, ok).join(at, by, "left").select(by, "n_requests", "n_ok", "n_failed", "mean_ms", "median_ms", "max_ms", "min_ms")


def provider_summary(requests: DataFrame, by: str = "run_id", ok: str = "view") -> DataFrame:
    """Mean, median and 95th percentile by run: the value at rank 0.95 (n - 1), rounded half to even.

    Ranks are found by counting, so that no group's latencies are gathered in one place.
    """
    ranks = middle_ranks() | {"p95_ms": F.bround(0.95 * (F.col("n") - 1))}
    at = values_at(requests, by, "latency_ms", ranks).select(by, median().alias("median_ms"), "p95_ms")
    rows = _latency_counts(requests, by, ok).join(at, by, "left")
    return rows.select(by, "n_requests", "n_ok", "n_failed", F.bround("mean_ms", 1).alias("mean_ms"), "median_ms", "p95_ms")


def failure_histogram(requests: DataFrame, ok: str = "view") -> DataFrame:
    return requests.filter(F.col("outcome") != ok).groupBy("outcome").agg(F.count("*").alias("n"))


def run_pivot(requests: DataFrame, runs: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Requests of every batch in each run, one column a run, and their mean."""
    out = requests.groupBy("batch_id").pivot("run_id", list(runs)).agg(F.count("request_id"))
    counts = [F.coalesce(F.col(str(r)), F.lit(0)).alias(f"run_{r}") for r in runs]
    rows = out.select("batch_id", *counts)
    return rows.withColumn("mean_yield", F.bround(sum((F.col(f"run_{r}") for r in runs), F.lit(0)) / len(runs), 1))


def speed_summary(requests: DataFrame, one: int = 0, other: int = 1) -> DataFrame:
    """How much faster a run is than another, by mean latency."""
    both = requests.filter(F.col("run_id").isin(one, other))
    means = both.groupBy("run_id").agg(F.avg("latency_ms").alias("mean"))
    medians = values_at(both, "run_id", "latency_ms", middle_ranks()).select("run_id", median().alias("median"))
    own = lambda r, c: F.max(F.when(F.col("run_id") == r, F.col(c)))  # noqa: E731  one row for a run
    rows = means.join(medians, "run_id", "left").agg(
        own(one, "mean").alias("mean_one"),
        own(other, "mean").alias("mean_other"),
        own(one, "median").alias("median_one"),
        own(other, "median").alias("median_other"),
    )
    return rows.withColumns({"speedup": F.bround(F.col("mean_one") / F.col("mean_other"), 4), "reduction_pct": F.bround(100 * (1 - F.col("mean_other") / F.col("mean_one")), 2)})


def interval_overlap(requests: DataFrame, bucket_ms: int = 600_000) -> DataFrame:
    """request_id and n_active: the request itself and all others of its run that overlap it.

    Overlapping intervals are counted as those that have started by its end less those that had ended
    before its start, by two running sums over a time line; no pairs are formed. The time line is cut
    into buckets whose totals are summed first, so a run is not bound to one task. Rows that repeat a
    request_id are intervals of their own, whose counts are added. A row without a start or an end overlaps
    nothing. One that ends before it starts overlaps those that hold all of the time between; these alone are paired.
    """
    r = requests.select("run_id", "request_id", "start_ms", "end_ms").filter("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    forward, turned = r.filter("end_ms >= start_ms"), r.filter("end_ms < start_ms")
    mark = lambda at, kind, s, e: F.struct(F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(s).alias("started"), F.lit(e).alias("ended"))
    # At one time: starts count before what asks for them; ends count only after what asks for earlier ones.
    events = F.array(mark("start_ms", 0, 1, 0), mark("end_ms", 1, 0, 0), mark("start_ms", 2, 0, 0), mark("end_ms", 3, 0, 1))
    line = forward.select("run_id", "request_id", F.explode(events).alias("e")).select("run_id", "request_id", "e.*").withColumn("bucket", F.floor(F.col("at") / bucket_ms))
    before = Window.partitionBy("run_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = line.groupBy("run_id", "bucket").agg(F.sum("started").alias("s"), F.sum("ended").alias("e"))
    totals = totals.select("run_id", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e0"))
    upto = Window.partitionBy("run_id", "bucket").orderBy("at", "kind")
    seen = line.withColumns({"s1": F.sum("started").over(upto), "e1": F.sum("ended").over(upto)}).filter("kind IN (1, 2)").join(totals, ["run_id", "bucket"])
    counted = seen.select("run_id", "request_id", F.when(F.col("kind") == 1, F.col("s0") + F.col("s1")).otherwise(-F.col("e0") - F.col("e1")).alias("n"))
    held = turned.select(F.col("run_id").alias("__run"), F.col("request_id").alias("__id"), F.col("start_ms").alias("__start"), F.col("end_ms").alias("__end"))
    paired = held.join(forward, (F.col("run_id") == F.col("__run")) & (F.col("start_ms") <= F.col("__end")) & (F.col("end_ms") >= F.col("__start")))
    paired = paired.select("run_id", F.explode(F.array("request_id", "__id")).alias("request_id"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(paired).groupBy("run_id", "request_id").agg(F.sum("n").alias("n_active"))


def last_known(requests: DataFrame, by: str = "batch_id", ok: str = "purchase") -> DataFrame:
    """The latest latency of a kind of request in each batch."""
    known = F.when(F.col("outcome") == ok, F.struct("start_ms", "request_id"))
    return requests.groupBy(by).agg(F.max_by("latency_ms", known).alias("last_ms"))


def signatures(normalized: DataFrame) -> DataFrame:
    """document_id and signature of every claim."""
    value = F.coalesce(F.col("value_numeric").cast("string"), F.col("value_raw"))
    parts = (strip(F.coalesce(c, F.lit(""))) for c in (F.col("canonical_entity"), F.col("canonical_metric"), value, F.coalesce("canonical_unit", "unit"), F.col("period_label"), F.col("scope"), F.col("geography")))
    return normalized.select("document_id", N.signature(F.concat(F.lit("p"), F.col("page_number").cast("string")), *parts).alias("signature"))


def signature_sets(sigs: DataFrame, one: str, other: str, how: str) -> DataFrame:
    """Set algebra of two reports' signatures: union, intersect, except, or symmetric."""
    a, b = (sigs.filter(F.col("document_id") == d).select("signature") for d in (one, other))
    if how == "union":
        return a.union(b).distinct()
    if how == "intersect":
        return a.intersect(b)
    if how == "except":
        return a.subtract(b)
    return a.union(b).distinct().subtract(a.intersect(b))


#: Runs of one word of a bitmap.
WORD = 62


def signature_runs(sigs: DataFrame, run: str = "document_id") -> DataFrame:
    """signature, runs (a bitmap in words of ``WORD`` runs), n_runs (how many have it), n_all and only_run of each signature.

    One aggregation over all runs, of any number, from which their set algebra is read: the union is every row,
    the intersection is ``n_runs = n_all``, what only one run has is ``only_run``, and ``in_runs`` asks for others.
    Runs are numbered from 0 in the order of their names.
    """
    order = Window.orderBy("__run")
    named = sigs.select(F.col(run).alias("__run")).distinct()
    numbers = durable(named.select("__run", (F.row_number().over(order) - 1).alias("__no")))  # one row for a run
    n = numbers.count()
    word = lambda k: F.bit_or(F.when(F.floor(F.col("__no") / WORD) == k, F.expr(f"shiftleft(1L, __no - {k * WORD})")).otherwise(F.lit(0).cast("long")))
    bits = sigs.join(numbers, F.col(run).eqNullSafe(F.col("__run"))).groupBy("signature").agg(F.array(*(word(k) for k in range(max(1, -(-n // WORD))))).alias("runs"), F.min("__run").alias("__first"))
    held = F.aggregate("runs", F.lit(0), lambda a, w: a + F.bit_count(w))
    rows = bits.withColumn("n_runs", held)
    return rows.select("signature", "runs", "n_runs", F.lit(n).alias("n_all"), F.when(F.col("n_runs") == 1, F.col("__first")).alias("only_run"))


def in_runs(numbers: Sequence[int], every: bool = False) -> Column:
    """Whether a signature's bitmap has any (or every) of the runs of these numbers."""
    has = [F.get(F.col("runs"), F.lit(k // WORD)).bitwiseAND(F.lit(1 << (k % WORD))) != 0 for k in numbers]
    out = F.lit(every)
    for h in has:
        out = (out & h) if every else (out | h)
    return F.coalesce(out, F.lit(False))


def signature_consistency(found: DataFrame, ones: Sequence[int], others: Sequence[int]) -> DataFrame:
    """Of two groups of runs, how many signatures all runs have, only the one or only the other group has, and not all have.

    ``found``: as of ``signature_runs``; runs by number.
    """
    one, other, common = in_runs(ones), in_runs(others), in_runs([*ones, *others], every=True)
    return found.agg(
        F.count_if(one | other).alias("n_union"),
        F.count_if(common).alias("n_common"),
        F.count_if(one & ~other).alias("n_only_one"),
        F.count_if(other & ~one).alias("n_only_other"),
        F.count_if((one | other) & ~common).alias("n_inconsistent"),
    )


def run_agreement(batches: DataFrame, one: int, other: int) -> DataFrame:
    """Batches of two runs side by side and whether their fingerprints are equal. ``batches``: run_id, batch_id, fingerprint."""
    a = batches.filter(F.col("run_id") == one).select("batch_id", F.col("fingerprint").alias("fingerprint_one"))
    b = batches.filter(F.col("run_id") == other).select("batch_id", F.col("fingerprint").alias("fingerprint_other"))
    return a.join(b, "batch_id", "full").withColumn("is_equal", F.coalesce(F.col("fingerprint_one") == F.col("fingerprint_other"), F.lit(False)))

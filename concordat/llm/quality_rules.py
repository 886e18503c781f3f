"""Quality rules whose cutoffs are certified on labelled documents (DataFrame expressions only).

A rule rejects a document when a measured ratio exceeds its cutoff. In each stratum (language) at most
``alpha`` of the good documents may be rejected by all rules together. Joint cutoffs are tried along one
sequence, fixed beforehand: it begins with no cutoff and tightens one rule after the other by one place of
its grid (``STEPS``). So each document has one step from which on it is rejected, by whichever rule. A step is
certified while the exact binomial tail rules out, at the corrected level, that more than ``alpha`` of the
good documents are rejected by its joint cutoffs: with ``k`` of ``n`` good labelled documents rejected,
P(Bin(n, alpha) <= k) must not exceed ``delta`` divided by the number of strata. As the sequence is fixed and
stops at the first failure, no further correction is due: with probability 1 - ``delta`` no stratum loses
more than ``alpha`` of its good documents. No share of ``alpha`` goes to rules that reject nothing: with four
strata, 86 good documents of which none is rejected are enough. Among the certified steps the one with the
best surplus of bad over good rejections is taken (ties: the laxest), and none if no step has a surplus. The
grid is fixed beforehand, so every labelled document serves as holdout. What is counted are different
documents: each labelled id once, and each text once in a stratum (good if any of its labels says so).

Defined results: a null text has no words; a null language is a stratum of its own; repeated labels of
a document count once and as good if any of them says so; of different texts under one labelled id the
one with the smallest MD5 counts; labels without a document, or with a null id or quality, are ignored;
with no labels nothing but the base rules rejects. Documents with equal ids are judged row by row. An
empty table gives no rows. Extra columns are carried and never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS_RUN, durable, let, words, written

WINDOW = 5
#: The share of a stratum's good documents that certified cutoffs may reject, and the risk of more.
ALPHA, DELTA = 0.05, 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> (ratio over the measures, cutoffs from the laxest to the strictest).
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04),
    "repeat_ratio": (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05),
    "dup_line_ratio": (0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "shout_ratio": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
}
#: The fixed sequence: (rule, cutoff) tightened at steps 1, 2, ...; all rules' first places, then all second ones.
STEPS = tuple((r, cuts[i]) for i in range(max(map(len, RULES.values()))) for r, cuts in RULES.items() if i < len(cuts))
NO_STRATUM = "\u0000none"
#: Above this many strata the cutoffs are joined by a shuffle and no longer broadcast.
MAX_BROADCAST_STRATA = 20_000


def _repeat_words(w: Column) -> Column:
    """Words covered by five-word windows that occur twice or more; windows compare by 64-bit hash."""

    def covered(grams: Column) -> Column:
        def count(ordered: Column) -> Column:
            twice = F.filter(
                ordered,
                lambda x, j: (F.get(ordered, j + 1)["h"].eqNullSafe(x["h"]))
                | ((j > 0) & F.get(ordered, F.greatest(j - 1, F.lit(0)))["h"].eqNullSafe(x["h"])),
            )
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            merged = F.aggregate(
                starts,
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
                lambda acc, p: F.struct(
                    (p + WINDOW).alias("end"),
                    (acc["total"] + p + WINDOW - F.greatest(acc["end"], p)).alias("total"),
                ),
            )
            return merged["total"]

        pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, count))

    grams = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(grams, covered))


def measure(text: Column) -> Column:
    """One struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeated")),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        F.md5(text.cast("binary")).alias("text_key"),
        F.length(F.regexp_replace(text, WS_RUN, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the measures and ratios of every document, in one pass without a shuffle."""
    ratio = lambda a, b: (a.cast("double") / F.greatest(b, F.lit(1)).cast("double"))
    m = F.col("__m")
    return docs.select(*keep, F.coalesce(F.col("lang"), F.lit(NO_STRATUM)).alias("stratum"), measure(F.col("text")).alias("__m")).select(
        *keep,
        "stratum",
        m["text_key"].alias("text_key"),
        m["w"]["n"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["l"]["dup"].alias("n_dup_lines"),
        m["w"]["repeated"].alias("n_repeat_words"),
        ((m["w"]["n"] < 10) | (100 * m["w"]["repeated"] > 20 * m["w"]["n"])).alias("base_failed"),
        ratio(m["n_symbols"], m["word_chars"]).alias("symbol_ratio"),
        ratio(m["w"]["repeated"], m["w"]["n"]).alias("repeat_ratio"),
        ratio(m["l"]["dup"], m["l"]["n"]).alias("dup_line_ratio"),
        ratio(m["n_upper"], m["word_chars"]).alias("upper_ratio"),
        ratio(m["n_shouts"], m["w"]["n"]).alias("shout_ratio"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k exceeds the mean."""
    n, odds = n.cast("double"), p / (1 - p)
    start = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")),
        F.struct(start.alias("term"), start.alias("sum")),
        lambda acc, j: let(
            acc["term"] + F.log((n - j + 1) / j * odds),
            lambda t: F.struct(
                t.alias("term"),
                (F.greatest(t, acc["sum"]) + F.log1p(F.exp(-F.abs(t - acc["sum"])))).alias("sum"),
            ),
        ),
    )["sum"]
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(F.exp(total))


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row for each stratum with a certified step: ``stratum`` and ``cut_<rule>`` (null: the step has none)."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    # One row for an id, and then one for a text: repeats are no trials of their own.
    first = F.min(F.struct("text_key", "stratum", "base_failed", *RULES)).alias("f")
    by_id = features.join(marks, "doc_id").groupBy("doc_id").agg(first, F.max("good").alias("good")).select("good", "f.*")
    trials = by_id.filter(~F.col("base_failed")).groupBy("stratum", "text_key").agg(F.max("good").alias("good"), *(F.max(r).alias(r) for r in RULES))
    # the first step that rejects, or one past the last
    past = len(STEPS) + 1
    step = F.least(*(F.when(F.col(r) > c, i + 1).otherwise(past) for i, (r, c) in enumerate(STEPS)))
    good = F.col("good") == 1
    hits = (
        trials.groupBy("stratum", step.alias("step"))
        .agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    )
    strata = hits.groupBy("stratum").agg(F.sum("good").alias("n"))
    cells = (
        strata.select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(past - 1))).alias("step"))
        .join(hits, ["stratum", "step"], "left")
        .crossJoin(F.broadcast(strata.agg(F.count("*").alias("n_strata"))))
    )
    laxer = Window.partitionBy("stratum").orderBy("step")
    tried = (
        cells.withColumn("k", F.sum(F.coalesce("good", F.lit(0))).over(laxer))
        .withColumn("caught", F.sum(F.coalesce("bad", F.lit(0))).over(laxer))
        .withColumn("ok", (binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(delta) / F.col("n_strata")).cast("int"))
        .withColumn("certified", F.min("ok").over(laxer) == 1)
    )
    best = (
        tried.filter("certified AND caught > k")
        .groupBy("stratum")
        .agg(F.max(F.struct((F.col("caught") - F.col("k")).alias("surplus"), (-F.col("step")).alias("lax")))["lax"].alias("lax"))
    )
    reached = lambda r: F.least(*(F.when(-F.col("lax") >= i + 1, F.lit(float(c))) for i, (x, c) in enumerate(STEPS) if x == r))
    return best.select("stratum", *(reached(r).alias(f"cut_{r}") for r in RULES))


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``features`` with ``rejected_by`` (array of rule names) and ``kept``."""
    cutoffs = durable(cutoffs)
    side = F.broadcast(cutoffs) if cutoffs.count() <= MAX_BROADCAST_STRATA else cutoffs
    broken = F.filter(
        F.array(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)), lambda x: x.isNotNull()
    )
    return (
        features.join(side, "stratum", "left")
        .withColumn("rejected_by", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop(*(f"cut_{r}" for r in RULES))
    )


def apply_quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Every document's measures, broken rules and verdict. ``docs``: doc_id, text, lang and any others."""
    features = durable(measured(docs, "doc_id"))
    return judge(features, certified_cutoffs(features, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, with their columns.

    Documents are written with their measures once, so that each text is measured once and never shuffled.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    rows = written(measured(docs.select(whole, "doc_id", "lang", "text"), "__doc", "doc_id"))
    cutoffs = certified_cutoffs(rows.drop("__doc"), labels, alpha, delta)
    return judge(rows, cutoffs).filter("kept").select("__doc.*")

"""Normalised facts and pairs of them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import vocab as V
from ..functions.text import bare, strip
from ..shared import MOST_HOT_KEYS, durable, small_methods, written

#: What a pair carries of each side, with the prefix a_ or b_.
CARRIED = (
    "pos", "fact_id", "document_id", "page_number", "metric", "value_raw", "period_label", "scope", "geography",
    "epistemic_status", "data_vintage", "supporting_text", "canonical_entity", "canonical_metric", "numeric_value",
    "canonical_unit", "currency", "norm_start", "norm_end", "ekey", "mkey", "scope_key", "geography_key", "vintage_key",
    "vintage_label", "restates", "resolution", "evidence", "time_marks", "unit_kind",
)


def normalize_facts(facts: DataFrame, calendar: str | None = None) -> DataFrame:
    """Facts with canonical value, unit, period, entity and metric, warnings, and the keys that pairs are found by."""
    optional = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    period = N.period(F.col("period_label"), F.lit(calendar).cast("string"), optional("period_start"), optional("period_end"))
    rows = facts.withColumns({"__v": N.value(F.col("value_raw"), F.col("unit"), F.col("value_numeric")), "__p": period})
    bounded = F.col("__p.start").isNotNull() & F.col("__p.end").isNotNull()
    named = rows.withColumns({"canonical_entity": N.entity(F.col("entity")), "canonical_metric": N.metric(F.col("metric"))})
    key = lambda c, raw: F.lower(strip(F.coalesce(F.nullif(c, F.lit("")), raw, F.lit(""))))
    out = named.select(
        *facts.columns,
        "canonical_entity",
        "canonical_metric",
        F.col("__v.numeric_value").alias("numeric_value"),
        F.col("__v.canonical_unit").alias("canonical_unit"),
        F.col("__v.scale").alias("scale"),
        F.col("__v.value_qualifier").alias("value_qualifier"),
        F.col("__v.currency").alias("currency"),
        F.col("__v.status").alias("normalization_status"),
        F.when(bounded, F.col("__p.start")).alias("norm_start"),
        F.when(bounded, F.col("__p.end")).alias("norm_end"),
        F.array_compact(F.array(F.col("__v.note"), F.when(~bounded, F.col("__p.warning")))).alias("warnings"),
        key(F.col("canonical_entity"), F.col("entity")).alias("ekey"),
        key(F.col("canonical_metric"), F.col("metric")).alias("mkey"),
    )
    return with_pair_keys(out)


def id_hash() -> Column:
    """Facts of one entity and id have the same; facts of others hardly ever."""
    return F.xxhash64(F.lit("fact_id"), "ekey", "fact_id")


#: What the value of a fact is read from, and what its period, metric and other terms are read from.
_VALUE = ("value_raw", "unit", "value_numeric")
_TERMS = ("period_label", "period_start", "period_end", "metric", "scope", "geography", "data_vintage")


def countable_facts(facts: DataFrame, calendar: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What the kind of a relation depends on, of every fact that can be paired, with no text; and the table it is read from.

    The columns are as of ``normalize_facts``, but for a hash in place of the id, and of the times that a text compares
    whether it does so by itself (``says``) or can begin a comparison (``begins``). Facts are written with what only
    their own text tells; their values and their terms, which many facts share, are normalised once for each that differs and joined to them, by a broadcast
    unless there are many.
    """
    none = lambda c: F.lit(None).cast("double" if c == "value_numeric" else "string").alias(c)
    facts = facts.select("*", *(none(c) for c in ("period_start", "period_end") if c not in facts.columns))
    text = F.col("evidence")
    able = _opens(text) | (F.contains(text, F.lit("in")) & F.regexp_like(text, F.lit(_IN_YEAR)))
    own = {"id_hash": id_hash(), "says": says_time(text), "begins": able}
    kept = ("pos", "ekey", "epistemic_status", "restates", *own, *_VALUE, *_TERMS)
    with small_methods(facts.sparkSession):
        rows = written(normalize_facts(facts, calendar).filter("pos IS NOT NULL AND fact_id IS NOT NULL AND ekey <> ''").withColumns(own).select(*kept))
    found = rows
    for by, made in ((_VALUE, ("numeric_value", "canonical_unit", "unit_kind", "resolution")), (_TERMS, ("mkey", "norm_start", "norm_end", "scope_key", "geography_key", "vintage_key", "vintage_label"))):
        blank = [none(c) for c in (*_VALUE, *_TERMS, "entity", "supporting_text") if c not in by]
        different = rows.select(*by).distinct().select(*by, *blank)
        told = written(normalize_facts(different, calendar).select(*(F.col(c).alias(f"__{c}") for c in by), *made))
        told = F.broadcast(told) if told.count() <= MOST_HOT_KEYS else told
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        found = found.join(told, reduce(and_, same)).drop(*(f"__{c}" for c in by))
    return found.filter("mkey <> ''").drop(*_VALUE, *_TERMS), rows


def with_pair_keys(facts: DataFrame) -> DataFrame:
    """What pairs are compared by, made once for a fact and not once for a pair."""
    said = lambda c: F.when(F.col(c) != "", F.lower(strip(F.col(c))))  # noqa: E731  white space only stays an empty text
    evidence = F.lower(bare("supporting_text"))
    context = F.lower(F.concat(F.coalesce("data_vintage", F.lit("")), F.lit(" "), F.coalesce("supporting_text", F.lit(""))))
    unit = F.lower(strip(F.coalesce("canonical_unit", F.lit(""))))
    kind = (
        F.when(unit.isin("", "count"), "free")
        .when(unit == "percent", "percent")
        .when(unit.isin(*V.CURRENCY_UNITS) | F.col("currency").isNotNull(), "money")
        .otherwise("other")
    )
    return facts.withColumn("evidence", evidence).withColumns(
        {
            "scope_key": said("scope"),
            "geography_key": said("geography"),
            "vintage_key": said("data_vintage"),
            "vintage_label": F.lower(strip(F.coalesce("data_vintage", F.lit("")))),
            "restates": _holds(context, V.SUPERSESSION_BY_WORD),
            "resolution": resolution(F.col("value_raw"), F.col("scale")),
            "unit_kind": kind,
            "time_marks": time_marks(F.col("evidence")),
        }
    )


#: Ends of a text with which a comparison of times may begin that goes on in the next text.
_OPENS = (
    r"\b(?:up|down|increased|decreased|rose|fell|grown|declined|compared|year|quarter|from|(?:year|quarter)[- ]on"
    r"|from\s+\S+|from\s+\S+\s+to)$"
)

#: One of these ends a text with such an end, unless it holds "from".
_OPENS_WITH = ("up", "down", "increased", "decreased", "rose", "fell", "grown", "declined", "compared", "year", "quarter", "on")


#: Bits of a text's time marks; above them stands how often it says "in" a year.
SAYS_TIME, OPENS_TIME, SAYS_WAS, IN_YEAR = 1, 2, 4, 8


#: A text that says "in" a year, or ends before it.
_IN_YEAR = r"\bin(?:\s+\d{4}\b|$)"


def _opens(text: Column) -> Column:
    return (F.contains(text, F.lit("from")) | F.greatest(*(F.endswith(text, F.lit(w)) for w in _OPENS_WITH))) & F.regexp_like(text, F.lit(_OPENS))


def time_marks(text: Column) -> Column:
    """All that pairs ask about the times in a lower-case text, as one number.

    Both sides of a pair carry the same columns, so that one shuffle can serve both sides of the join.
    """
    bit = lambda test, b: F.when(test, b).otherwise(0)
    has = lambda w: F.contains(text, F.lit(w))
    opens = _opens(text)
    was = has("was") & F.regexp_like(text, F.lit(r"\bwas\b"))
    years = F.when(has("in"), F.regexp_count(text, F.lit(_IN_YEAR))).otherwise(0)
    return bit(says_time(text), SAYS_TIME) + bit(opens, OPENS_TIME) + bit(was, SAYS_WAS) + IN_YEAR * years


def _holds(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """Whether a text holds any of the phrases, which are asked for only where it holds the word they need."""
    has = lambda w: F.contains(text, F.lit(w))
    return reduce(or_, (has(word) if word in said else has(word) & reduce(or_, map(has, said)) for word, said in phrases.items()))


def says_time(text: Column) -> Column:
    """Whether a lower-case text compares times by itself.

    A pattern is run only over texts with a word that it needs, which few have.
    """
    out = _holds(text, V.TEMPORAL_PHRASES_BY_WORD)
    for pattern, needed in zip(V.TEMPORAL_PATTERNS, V.TEMPORAL_NEEDS, strict=True):
        able = F.lit(False)
        for word in needed:
            able = able | F.contains(text, F.lit(word))
        out = out | (able & F.regexp_like(text, F.lit(pattern)))
    return out


def resolution(raw: Column, scale: Column) -> Column:
    """The smallest step that a value's notation shows, as an exact decimal."""
    kept = F.regexp_replace(F.regexp_replace(raw, r"[^0-9.\-+]", ""), r"^\++", "")
    places = F.least(F.length(F.coalesce(F.try_element_at(F.split(kept, r"\."), F.lit(2)), F.lit(""))), F.lit(12))
    step = F.element_at(F.array(*(F.lit(f"1e-{k}").cast("decimal(13,12)") for k in range(13))), places + 1)
    return (step * N.power_of_ten(scale)).cast("decimal(28,12)")


def _side(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(*(F.col(c).alias(prefix + c) for c in CARRIED))


def pair_up(facts: DataFrame, exact_metric: bool) -> DataFrame:
    """Pairs of different facts of one entity, the earlier first; with ``exact_metric`` also of one metric.

    A hash-partitioned equi-join that adaptive execution splits where an entity is skewed. All pairs of a
    key are made, so that it serves to list pairs; relations are found by ``surfacing_pairs``.
    """
    able = facts.filter("ekey <> '' AND mkey <> ''")
    a, b = _side(able, "a_"), _side(able, "b_")
    on = (F.col("a_ekey") == F.col("b_ekey")) & (F.col("a_pos") < F.col("b_pos")) & (F.col("a_fact_id") != F.col("b_fact_id"))
    if exact_metric:
        on = on & (F.col("a_mkey") == F.col("b_mkey"))
    return a.hint("merge").join(b, on).filter(units_agree())  # a broadcast side would leave the pairs to few tasks


def pairs_by_period(left: DataFrame, right: DataFrame, extra: Column, surfaces: Column) -> DataFrame:
    """Pairs (``CARRIED`` of each side) of one entity and metric that can surface, by what can make them do so.

    A pair surfaces if its periods are equal, or one is missing, or its texts compare times. So facts meet

    * by entity, metric and period, which takes all pairs with equal periods;
    * by entity and metric where the left one has no period or its text may open a comparison;
    * by entity and metric where that holds for the right one only.

    The facts of many periods under one key, which are the most, never meet one another but by period.
    ``extra`` and ``surfaces`` are conditions of the pair, evaluated inside of the joins.
    """
    bounded = F.col("norm_start").isNotNull() & F.col("norm_end").isNotNull()
    says = lambda bit: F.col("time_marks").bitwiseAND(bit) != 0
    years = F.shiftright("time_marks", 3)
    free_left = ~bounded | says(SAYS_TIME) | says(OPENS_TIME) | (says(SAYS_WAS) & (years >= 1))
    free_right = ~bounded | says(SAYS_TIME) | (years >= 2)
    able = lambda df: df.filter("ekey <> '' AND mkey <> ''")
    a, b = _side(able(left), "a_"), _side(able(right), "b_")
    has = lambda p: F.col(f"{p}norm_start").isNotNull() & F.col(f"{p}norm_end").isNotNull()
    one_key = (F.col("a_ekey") == F.col("b_ekey")) & (F.col("a_mkey") == F.col("b_mkey"))
    one_period = (F.col("a_norm_start") == F.col("b_norm_start")) & (F.col("a_norm_end") == F.col("b_norm_end"))
    apart = ~(has("a_") & has("b_") & F.coalesce(one_period, F.lit(False)))
    both = extra & units_agree() & surfaces
    by_period = a.filter(has("a_")).hint("merge").join(b.filter(has("b_")), one_key & one_period & both)
    left_free, right_free = able(left).filter(free_left), able(right).filter(free_right)
    left_bound = able(left).filter(~F.coalesce(free_left, F.lit(True)))
    by_left = _side(left_free, "a_").hint("merge").join(b, one_key & apart & both)
    by_right = _side(left_bound, "a_").hint("merge").join(_side(right_free, "b_"), one_key & apart & both)
    return by_period.unionByName(by_left).unionByName(by_right)


def units_agree() -> Column:
    """False if one side of a pair is in a currency and the other in percent."""
    a, b = F.col("a_unit_kind"), F.col("b_unit_kind")
    return ~(((a == "money") & (b == "percent")) | ((a == "percent") & (b == "money")))


def metric_tokens(metric: Column) -> Column:
    """The distinct telling words of a metric, in the singular."""

    def singular(t: Column) -> Column:
        n = F.length(t)
        cut = lambda k: F.substring(t, F.lit(1), n - k)
        third = F.substring(t, F.lit(-3), F.lit(1))
        return (
            F.when(F.endswith(t, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(F.endswith(t, F.lit("es")) & (n > 4) & third.isin(*"sxyzch"), cut(2))
            .when(F.endswith(t, F.lit("s")) & ~F.endswith(t, F.lit("ss")) & (n > 3), cut(1))
            .otherwise(t)
        )

    words = F.regexp_extract_all(F.lower(metric), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(*V.METRIC_STOPWORDS)), singular))


def metric_terms(facts: DataFrame) -> DataFrame:
    """ekey, mkey, tokens and core of every distinct metric of an entity; tokens stand from rare to frequent.

    How frequent a token is follows from all distinct metrics. Words are read off each distinct metric once.
    """
    able = facts.filter("ekey <> '' AND mkey <> ''").select("ekey", "mkey").distinct()
    words = able.select("mkey").distinct().select("mkey", F.explode(metric_tokens(F.col("mkey"))).alias("token"))
    counts = words.groupBy("token").agg(F.count("*").alias("n"))
    ordered = words.join(counts, "token").groupBy("mkey").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    named = ordered.select("mkey", F.transform("o", lambda x: x["token"]).alias("tokens"))
    core = F.filter("tokens", lambda x: ~x.isin(*V.QUANTITY_WORDS))
    return able.join(named, "mkey").select("ekey", "mkey", "tokens", core.alias("core"))


def metric_candidates(terms: DataFrame) -> DataFrame:
    """Pairs of different metrics of one entity that can be near each other, by tokens that both have.

    A set-similarity join by prefixes: of two sets with at least half of all their tokens in common, each has
    one of its ``size // 2 + 1`` rarest tokens in common with the other's; a set within another has its own
    rarest token there. A pair may be found in several ways, and the side a is the smaller metric.
    """

    def filed(tokens: Column, name: str) -> DataFrame:
        kept = [F.col(c).alias(f"{name}_{c}") for c in ("mkey", "tokens", "core")]
        return terms.select("ekey", F.explode(tokens).alias("token"), *kept)

    t, c = F.col("tokens"), F.col("core")
    size = lambda side, of="tokens": F.size(f"{side}_{of}")
    prefix = F.slice(t, F.lit(1), F.floor(F.size(t) / 2).cast("int") + 1)
    on = ["ekey", "token"]
    alike = filed(prefix, "a").join(filed(prefix, "b"), on).filter("a_mkey < b_mkey")
    alike = alike.filter((2 * size("a") >= size("b")) & (2 * size("b") >= size("a")))

    def within(tokens: Column, of: str) -> DataFrame:
        """One set's rarest token among another's, put in order."""
        found = filed(F.slice(tokens, 1, 1), "a").join(filed(tokens, "b"), on).filter("a_mkey <> b_mkey").filter(size("a", of) <= size("b", of))
        turned = F.col("a_mkey") > F.col("b_mkey")
        sides = [(F.when(turned, F.col(f"{y}_{k}")).otherwise(F.col(f"{x}_{k}"))).alias(f"{x}_{k}") for x, y in ("ab", "ba") for k in ("mkey", "tokens", "core")]
        return found.select("ekey", *sides)

    columns = ["ekey", *(f"{x}_{k}" for x in "ab" for k in ("mkey", "tokens", "core"))]
    return alike.select(*columns).unionByName(within(t, "tokens")).unionByName(within(c, "core"))


def near_metrics(terms: DataFrame) -> DataFrame:
    """ekey, a_mkey, b_mkey (the greater one), candidate_score and reasons of different metrics that are near enough."""
    ta, tb, ca_, cb_ = F.col("a_tokens"), F.col("b_tokens"), F.col("a_core"), F.col("b_core")
    pairs = metric_candidates(terms).withColumns({"common": F.array_intersect(ta, tb), "common_core": F.array_intersect(ca_, cb_)})
    n, na, nb = F.size("common"), F.size(ta), F.size(tb)
    nc, ca, cb = F.size("common_core"), F.size(ca_), F.size(cb_)
    union = na + nb - n
    cores = (ca > 0) & (cb > 0)
    kind = (
        F.when((na == 0) | (nb == 0), None)
        .when((n == na) & (n == nb), "tokens")
        .when((n == na) | (n == nb), "subset")
        .when(cores & (nc == ca) & (nc == cb), "core")
        .when(cores & ((nc == ca) | (nc == cb)), "core_subset")
        .when(2 * n >= union, "overlap")
    )
    # Hundredths of (1 + n / union) / 2, ties to even, in whole numbers.
    twice, unit = 100 * (union + n), 2 * union
    whole, rest = F.floor(twice / unit), F.pmod(twice, unit)
    rounded = whole + F.when(2 * rest > unit, 1).when((2 * rest == unit) & (whole % 2 == 1), 1).otherwise(0)
    score = F.when(F.col("kind") == "tokens", 0.95).when(F.col("kind") == "subset", 0.85).when(F.col("kind") == "core", 0.80).when(F.col("kind") == "core_subset", 0.75).otherwise(rounded / 100)
    listed = lambda c: F.array_join(F.array_sort(c), ", ")
    reason = (
        F.when(F.col("kind") == "tokens", "CANONICAL_METRIC_TOKEN_MATCH")
        .when(F.col("kind") == "subset", F.concat(F.lit("METRIC_SUBSET_MATCH: "), listed("common")))
        .when(F.col("kind") == "core", F.concat(F.lit("METRIC_CORE_NOUN_MATCH: "), listed("common_core")))
        .when(F.col("kind") == "core_subset", F.concat(F.lit("METRIC_CORE_SUBSET_MATCH: "), listed("common_core")))
        .otherwise(F.concat(F.lit("HIGH_PRECISION_METRIC_OVERLAP (Jaccard "), F.format_number(n / union, 2), F.lit("): "), listed("common")))
    )
    found = pairs.withColumn("kind", kind).filter("kind IS NOT NULL").withColumns({"candidate_score": score, "reasons": F.array(F.lit("ENTITY_MATCH"), reason)})
    return found.select("ekey", "a_mkey", "b_mkey", "candidate_score", "reasons").dropDuplicates(["ekey", "a_mkey", "b_mkey"])


def candidate_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of one entity whose metrics are near enough, with score and reasons.

    Which metrics of an entity are near is found among its distinct metrics, by shared tokens; facts then meet
    by metrics that are equal or near, so that hardly more pairs are made than are given.
    """
    facts = durable(facts)  # read for the terms and for both sides
    able = facts.filter("ekey <> '' AND mkey <> ''")
    exact = pair_up(facts, exact_metric=True).withColumns({"candidate_score": F.lit(1.0), "reasons": F.array(F.lit("ENTITY_MATCH"), F.lit("EXACT_METRIC_MATCH"))})
    near = near_metrics(metric_terms(facts)).select(F.col("ekey").alias("of"), F.col("a_mkey").alias("one"), F.col("b_mkey").alias("other"), "candidate_score", "reasons")
    first = _side(able, "a_").hint("merge").join(near, (F.col("a_ekey") == F.col("of")) & (F.col("a_mkey") == F.col("one")))
    met = first.hint("merge").join(_side(able, "b_"), (F.col("of") == F.col("b_ekey")) & (F.col("other") == F.col("b_mkey")) & (F.col("a_fact_id") != F.col("b_fact_id")) & (F.col("a_pos") != F.col("b_pos")) & units_agree())
    turned = F.col("a_pos") > F.col("b_pos")  # the earlier fact comes first, whichever metric it has
    sides = [F.when(turned, F.col(y + c)).otherwise(F.col(x + c)).alias(x + c) for x, y in (("a_", "b_"), ("b_", "a_")) for c in CARRIED]
    return exact.unionByName(met.select(*sides, "candidate_score", "reasons"))

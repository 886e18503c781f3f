"""From pairs of facts to relations: comparability, surfacing, classification."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import short_hash
from ..shared import MOST_HOT_KEYS, small_methods, written
from .facts import CARRIED, OPENS_TIME, SAYS_TIME, SAYS_WAS, countable_facts, id_hash, normalize_facts, pairs_by_period, units_agree

#: What is said of each surfacing decision.
SURFACE_TEXTS = {
    "SAME_DOCUMENT_DUPLICATE": "Duplicate or self-comparison of the same extracted fact.",
    "MEANINGFUL_COMPARISON": "Claims are comparable across all verified dimensions.",
    "METRIC_MISMATCH_SUPPRESSED": "Claims represent different metrics/measurements.",
    "EXPLICIT_TEMPORAL_COMPARISON": "Source evidence explicitly contains temporal comparison language connecting the periods.",
    "DIFFERENT_TIME_PERIOD_NO_LINK": "Claims describe different bounded time periods without explicit comparative language in source text.",
    "INSUFFICIENT_CONTEXT_MEANINGFUL": "Meaningful claim comparison with unresolved missing contextual dimensions.",
    "WEAK_SEMANTIC_CANDIDATE": "Candidate pair lacks sufficient core alignment to surface as an unresolved relationship.",
}


def _quote(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("None")) for p in parts))


def gates() -> dict[str, tuple[Column, Column]]:
    """For each gating dimension of a pair whether something is missing, and whether it does not match."""
    out: dict[str, tuple[Column, Column]] = {}
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    for name, column in (("entity", "ekey"), ("metric", "mkey"), ("unit", "canonical_unit")):
        both = filled(f"a_{column}") & filled(f"b_{column}")
        out[name] = (~both, both & (F.col(f"a_{column}") != F.col(f"b_{column}")))
    bounded = F.col("a_norm_start").isNotNull() & F.col("b_norm_start").isNotNull()
    equal = (F.col("a_norm_start") == F.col("b_norm_start")) & F.col("a_norm_end").eqNullSafe(F.col("b_norm_end"))
    out["time_period"] = (~bounded, bounded & ~equal)
    for name in ("scope", "geography"):
        a, b = F.col(f"a_{name}_key"), F.col(f"b_{name}_key")
        told = filled(f"a_{name}_key") & filled(f"b_{name}_key")
        out[name] = (~told & ~a.eqNullSafe(b), told & (a != b))
    return out


def _any(flags) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs with comparability ``status``, ``codes`` and ``dim_<dimension>`` (what was found for each dimension).

    A mismatch makes a pair NON_COMPARABLE, else what is missing makes it INSUFFICIENT_CONTEXT; epistemic
    status and vintage are noted only. The codes by dimension are columns too (``code_<dimension>``).
    """
    c = F.col
    flags = gates()
    said = {"entity": "ENTITY", "metric": "METRIC", "unit": "UNIT", "time_period": "TIME", "scope": "SCOPE", "geography": "GEOGRAPHY"}
    codes = [F.when(flags[k][0], f"MISSING_{k.upper()}").when(flags[k][1], f"{name}_MISMATCH") for k, name in said.items()]
    dims: dict[str, Column] = {}

    def told(name: str, a: Column, b: Column, missing: Column, neither: Column | None = None) -> None:
        lacking, differing = flags[name]
        out = F.when(lacking, missing).when(differing, _quote("mismatch ('", a, "' != '", b, "')"))
        out = out if neither is None else out.when(neither, "compatible (both unspecified)")
        dims[name] = out.otherwise(_quote("compatible ('", a, "')"))

    told("entity", c("a_ekey"), c("b_ekey"), F.lit("unresolved (missing entity)"))
    told("metric", c("a_mkey"), c("b_mkey"), F.lit("unresolved (missing metric)"))
    u_a, u_b = c("a_canonical_unit"), c("b_canonical_unit")
    told("unit", u_a, u_b, _quote("unresolved unit (fact_a='", u_a, "', fact_b='", u_b, "')"))
    s1, e1, s2, e2 = (c(x) for x in ("a_norm_start", "a_norm_end", "b_norm_start", "b_norm_end"))
    dims["time_period"] = (
        F.when(flags["time_period"][0], "unresolved interval")
        .when(flags["time_period"][1], _quote("mismatch (", s1, "..", e1, " vs ", s2, "..", e2, ")"))
        .otherwise(_quote("compatible (", s1, " to ", e1, ")"))
    )
    for name in ("scope", "geography"):
        a, b = c(f"a_{name}_key"), c(f"b_{name}_key")
        told(name, a, b, _quote("unspecified on one claim (fact_a='", a, "', fact_b='", b, "')"), F.coalesce(a, F.lit("")) == "")
    ep_a, ep_b = c("a_epistemic_status"), c("b_epistemic_status")
    codes.append(F.when(ep_a != ep_b, "EPISTEMIC_STATUS_DIFFERENCE"))
    dims["epistemic_status"] = F.when(ep_a != ep_b, _quote("differs ('", ep_a, "' vs '", ep_b, "')")).otherwise(_quote("matching ('", ep_a, "')"))
    v_a, v_b = c("a_vintage_key"), c("b_vintage_key")
    differ = (F.coalesce(v_a, F.lit("")) != "") & (F.coalesce(v_b, F.lit("")) != "") & (v_a != v_b)
    codes.append(F.when(differ, "DATA_VINTAGE_DIFFERENCE"))
    dims["data_vintage"] = F.when(differ, _quote("differs ('", v_a, "' vs '", v_b, "')")).otherwise("compatible / unspecified")

    # The code of each dimension is a column of its own, so that deciding needs no array.
    out = pairs.withColumns({f"code_{k}": c for k, c in zip(V.DIMENSIONS, codes, strict=True)})
    hard, lacking = _any(f[1] for f in flags.values()), _any(f[0] for f in flags.values())
    status = F.when(hard, "NON_COMPARABLE").when(lacking, "INSUFFICIENT_CONTEXT").otherwise("COMPARABLE")
    listed = F.array_compact(F.array(*(F.col(f"code_{k}") for k in V.DIMENSIONS)))
    differs = lambda k, text: F.when(flags[k][1], text)
    versus = lambda a, b: _quote("'", a, "' vs '", b, "'.")
    free = lambda k, one, many: (
        F.when(flags[k][1], F.concat(F.lit(f"Conflicting {many}: "), versus(c(f"a_{k}_key"), c(f"b_{k}_key"))))
        .when(flags[k][0], f"{one} is specified on one claim but unspecified on the other.")
    )
    # What is noted of each dimension.
    notes = [
        differs("entity", F.concat(F.lit("Different entities: "), versus(c("a_ekey"), c("b_ekey")))),
        differs("metric", F.concat(F.lit("Different metrics: "), versus(c("a_mkey"), c("b_mkey")))),
        F.when(flags["unit"][0], "Unit/currency could not be safely resolved on one or both facts.").when(flags["unit"][1], F.concat(F.lit("Incompatible units: "), versus(u_a, u_b))),
        F.when(flags["time_period"][0], "Time period interval not safely bounded on one or both facts.").when(
            flags["time_period"][1], _quote("Different measurement periods: [", s1, " to ", e1, "] vs [", s2, " to ", e2, "].")
        ),
        free("scope", "Scope", "scopes"),
        free("geography", "Geography", "geographies"),
        F.when(ep_a != ep_b, F.concat(F.lit("Epistemic status differs: "), versus(ep_a, ep_b))),
        F.when(differ, F.concat(F.lit("Data vintage differs: "), versus(v_a, v_b))),
    ]
    return out.withColumns({"status": status, "codes": listed, "notes": F.array_compact(F.array(*notes))} | {f"dim_{k}": dims[k] for k in V.DIMENSIONS})


def compared_dimensions() -> Column:
    """The dimensions of a compared pair as a map."""
    return F.create_map(*(x for k in V.DIMENSIONS for x in (F.lit(k), F.col(f"dim_{k}"))))


def temporal_language(pairs_of: tuple[str, str] = ("a_", "b_")) -> Column:
    """Whether a pair's supporting texts compare times: either by itself, or a pattern across both.

    The patterns run over both texts only where the first can begin what the second goes on with.
    """
    a, b = pairs_of
    c = F.col
    mark = lambda p, bit: c(p + "time_marks").bitwiseAND(bit) != 0
    in_year = lambda p: F.shiftright(p + "time_marks", 3)
    across = mark(a, OPENS_TIME) | (mark(a, SAYS_WAS) & (in_year(a) + in_year(b) >= 2))
    both = F.concat(c(a + "evidence"), F.lit(" "), c(b + "evidence"))
    hit = F.lit(False)
    for pattern in V.TEMPORAL_PATTERNS:
        hit = hit | F.regexp_like(both, F.lit(pattern))
    return mark(a, SAYS_TIME) | mark(b, SAYS_TIME) | (across & hit)


def surface(compared: DataFrame, metric_match: Column | None = None) -> DataFrame:
    """Compared pairs with ``should_surface`` and ``surface_code``; pairs of the pipeline match in metric."""
    match = F.lit(True) if metric_match is None else F.coalesce(metric_match, F.lit(False))
    column = {"ENTITY": "entity", "METRIC": "metric", "TIME": "time_period", "UNIT": "unit"}
    has = lambda c: F.coalesce(F.col(f"code_{column[c.split('_')[0]]}") == c, F.lit(False))
    linked = temporal_language()
    conflict = has("ENTITY_MISMATCH") | has("METRIC_MISMATCH") | has("TIME_MISMATCH") | has("UNIT_MISMATCH")
    code = (
        F.when(F.col("a_fact_id") == F.col("b_fact_id"), "SAME_DOCUMENT_DUPLICATE")
        .when(F.col("status") == "COMPARABLE", "MEANINGFUL_COMPARISON")
        .when((F.col("status") == "NON_COMPARABLE") & has("METRIC_MISMATCH"), "METRIC_MISMATCH_SUPPRESSED")
        .when((F.col("status") == "NON_COMPARABLE") & has("TIME_MISMATCH") & linked, "EXPLICIT_TEMPORAL_COMPARISON")
        .when((F.col("status") == "NON_COMPARABLE") & has("TIME_MISMATCH"), "DIFFERENT_TIME_PERIOD_NO_LINK")
        .when(F.col("status") == "NON_COMPARABLE", "NON_COMPARABLE_NOT_MEANINGFUL")
        .when(match & ~conflict, "INSUFFICIENT_CONTEXT_MEANINGFUL")
        .otherwise("WEAK_SEMANTIC_CANDIDATE")
    )
    shown = F.col("surface_code").isin("MEANINGFUL_COMPARISON", "EXPLICIT_TEMPORAL_COMPARISON", "INSUFFICIENT_CONTEXT_MEANINGFUL")
    also = F.when(
        F.col("surface_code").isin("METRIC_MISMATCH_SUPPRESSED", "DIFFERENT_TIME_PERIOD_NO_LINK", "WEAK_SEMANTIC_CANDIDATE"), F.array(F.lit("NON_COMPARABLE_NOT_MEANINGFUL"))
    ).when(F.col("surface_code") == "NON_COMPARABLE_NOT_MEANINGFUL", F.col("codes")).otherwise(F.array().cast("array<string>"))
    told = F.when(F.col("surface_code") == "NON_COMPARABLE_NOT_MEANINGFUL", _quote("Claims are fundamentally non-comparable (", F.array_join("codes", ", "), ")."))
    for k, text in SURFACE_TEXTS.items():
        told = told.when(F.col("surface_code") == k, text)
    out = compared.withColumn("surface_code", code).withColumn("should_surface", shown)
    return out.withColumns({"surface_reasons": F.concat(F.array("surface_code"), also), "surface_explanation": told})


def surfaces() -> Column:
    """Whether a pair that matches in metric surfaces, straight from its keys.

    The same decision as of ``surface``, small enough to be evaluated inside of the join.
    """
    flags = gates()
    hard = _any(f[1] for f in flags.values())
    linked = flags["time_period"][1] & ~flags["metric"][1] & temporal_language()
    return (F.col("a_fact_id") != F.col("b_fact_id")) & (~hard | linked)


def relation_id(a: Column, b: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel-"), short_hash(F.concat_ws("|", a, b, kind)))


def classify(compared: DataFrame) -> DataFrame:
    """The relation of every compared pair: type, confidence, reason codes, factors, explanation and id."""
    c = F.col
    planned, observed = ("target", "projected"), ("reported", "audited")
    st_a, st_b = c("a_epistemic_status"), c("b_epistemic_status")
    apart = (st_a.isin(*planned) & st_b.isin(*observed)) | (st_b.isin(*planned) & st_a.isin(*observed))
    v_a, v_b = c("a_vintage_label"), c("b_vintage_label")
    steps = sorted("|".join(sorted(pair)) for pair in V.VINTAGE_STEPS)
    pair = F.array_join(F.array_sort(F.array(v_a, v_b)), "|")
    x, y = c("a_numeric_value"), c("b_numeric_value")
    coarse = F.greatest(c("a_resolution"), c("b_resolution"))
    step = (
        F.when(c("status") == "NON_COMPARABLE", "gate")
        .when(c("status") == "INSUFFICIENT_CONTEXT", "context")
        .when(apart, "epistemic")
        .when(c("b_restates") | c("a_restates"), "supersedes")
        .when((v_a != "") & (v_b != "") & (v_a != v_b) & pair.isin(steps), "evolves")
        .when((v_a != "") & (v_b != "") & (v_a != v_b), "vintage")
        .when(x.isNull() | y.isNull(), "non_numeric")
        .when(x == y, "equal")
        .when(F.abs(x - y) <= (coarse * F.lit("0.5").cast("decimal(2,1)")).cast("double"), "rounding")
        .otherwise("conflict")
    )
    rows = compared.withColumns({"step": step, "__res": coarse})
    by = lambda table, default=None: _by_step(table, default)
    kind = by({"supersedes": "SUPERSEDES", "evolves": "EVOLVES_FROM", "equal": "CORROBORATES", "rounding": "CONTEXT_RESOLVES", "conflict": "CONTRADICTS"}, "UNRESOLVED")
    confidence = by({"gate": 0.0, "context": 0.0, "epistemic": 0.9, "supersedes": 0.95, "evolves": 0.95, "vintage": 0.8, "non_numeric": 0.5, "equal": 1.0, "rounding": 0.95}, 0.95)
    own = {
        "epistemic": ["EPISTEMIC_STATUS_INCOMPATIBLE", "EPISTEMIC_STATUS_DIFFERENCE"],
        "supersedes": ["EXPLICIT_SUPERSEDED_CLAIM"],
        "evolves": ["DATA_VINTAGE_EVOLUTION", "LATER_DATA_VINTAGE"],
        "vintage": ["UNRESOLVED_VINTAGE_RELATIONSHIP", "DATA_VINTAGE_DIFFERENCE"],
        "non_numeric": ["NON_NUMERIC_COMPARISON"],
        "equal": ["EQUAL_NORMALIZED_VALUE"],
        "rounding": ["ROUNDING_DIFFERENCE", "CONTEXTUAL_RESOLUTION"],
        "conflict": ["VALUE_CONFLICT"],
    }
    array = lambda xs: F.array(*(F.lit(v) for v in xs)) if xs else F.array().cast("array<string>")
    reasons = by({k: array(v) for k, v in own.items()} | {"gate": F.concat(array(["NON_COMPARABLE_CLAIMS"]), c("codes")), "context": F.concat(array(["INSUFFICIENT_CONTEXT"]), c("codes"))})
    factors = by(
        {
            "epistemic": array(["epistemic_status"]),
            "supersedes": array(["supersession_evidence"]),
            "evolves": array(["data_vintage"]),
            "vintage": array(["data_vintage"]),
            "non_numeric": array([]),
            "equal": array(["normalized_value"]),
            "rounding": array(["display_rounding", "scale_resolution"]),
            "conflict": array(["value_conflict"]),
        },
        array(V.DIMENSIONS),
    )
    unit = F.coalesce(c("a_canonical_unit"), F.lit(""))
    listed = F.array_join("codes", ", ")
    newer, older = F.when(c("b_restates"), "Fact B").otherwise("Fact A"), F.when(c("b_restates"), "Fact A").otherwise("Fact B")
    money = lambda v: F.format_number(v, 2)
    # How each relation is explained.
    told = by(
        {
            "gate": _quote("Claims cannot be compared because the Comparability Gate identified incompatibility (", listed, "). Fact A: '", c("a_metric"), "' (", c("a_period_label"), "), Fact B: '", c("b_metric"), "' (", c("b_period_label"), ")."),
            "context": _quote("Relationship cannot be safely established due to missing context (", listed, ")."),
            "epistemic": _quote("Fact A (", st_a, ") and Fact B (", st_b, ") represent distinct epistemic categories (target/projection vs observed actuals) and are not contradictory."),
            "supersedes": _quote(newer, " explicitly supersedes/restates the earlier claim in ", older, " based on official revision evidence."),
            "evolves": _quote("Fact B ('", c("b_data_vintage"), "') represents a subsequent data vintage revision of the claim in Fact A ('", c("a_data_vintage"), "') for ", c("a_canonical_metric"), " in ", c("a_period_label"), "."),
            "vintage": _quote("Facts have different data vintages ('", c("a_data_vintage"), "' vs '", c("b_data_vintage"), "'), but sequential revision relationship is not explicitly established."),
            "non_numeric": F.lit("One or both facts lack normalized numerical values for mathematical comparison."),
            "equal": _quote("Both sources independently corroborate the identical canonical value of ", money(x), " ", unit, " for ", c("a_canonical_entity"), " '", c("a_canonical_metric"), "' in ", c("a_period_label"), "."),
            "rounding": _quote("The claims (", c("a_value_raw"), " vs ", c("b_value_raw"), ") appear different at surface level, but are mathematically consistent with display rounding within the implied ", F.format_number(c("__res").cast("double"), 0), " ", unit, " resolution."),
            "conflict": _quote("Both sources report materially conflicting values for ", c("a_canonical_entity"), " '", c("a_canonical_metric"), "' in ", c("a_period_label"), " (", c("a_value_raw"), " [", money(x), " ", unit, "] vs ", c("b_value_raw"), " [", money(y), " ", unit, "]) exceeding display rounding precision without contextual justification."),
        }
    )
    out = rows.withColumns({"relationship_type": kind, "confidence": confidence, "reason_codes": reasons, "contextual_factors": factors, "explanation": told})
    return out.withColumn("relationship_id", relation_id(c("a_fact_id"), c("b_fact_id"), c("relationship_type"))).drop("__res")


def _by_step(table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("step") == k, v) if out is None else out.when(F.col("step") == k, v)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def relate(normalized: DataFrame) -> DataFrame:
    """Relations that surface among normalised facts: the pipeline from claims to audited edges."""
    with small_methods(normalized.sparkSession):
        normalized = written(normalized.select(*CARRIED))  # what pairs are made of is made once, for all joins, which read what they need
    order = (F.col("a_pos") < F.col("b_pos")) & (F.col("a_fact_id") != F.col("b_fact_id"))
    return classify(compare(pairs_by_period(normalized, normalized, order, surfaces())))


def relation_counts(facts: DataFrame) -> DataFrame:
    """relationship_type, confidence and n, how many relations of each ``relate`` finds, without listing them.

    Whether a pair surfaces, and as what, depends on a few columns of either side and not on which comes first, but
    for texts that compare times only together. So facts of one entity and metric that agree in these columns are
    counted, and pairs of such cells are multiplied:

    * of pairs of equal periods each is of the kind that ``classify`` tells of its cells;
    * of the others, those where one has no period are UNRESOLVED if unit, scope and geography do not conflict, and
      those where both have one are if either text compares times, whatever their values;
    * pairs whose texts compare times only together are listed, if any text can begin such a comparison.

    A fact makes no pair with one of the same place or id: such pairs are counted alike and taken off.
    """
    found, rows = countable_facts(facts)
    found = found.withColumn("bounded", F.col("norm_start").isNotNull() & F.col("norm_end").isNotNull())
    counts = [_counted(found).withColumn("sign", F.lit(1))]
    # Pairs with the same id, and with the same place, less those counted twice with that.
    for rows_of, keys, sign in _repeated(facts, found, rows):
        counts.append(_counted(rows_of, *keys).withColumn("sign", F.lit(sign)))
    if not rows.filter("begins AND NOT says").isEmpty():
        counts.append(_across_texts(facts, rows.filter("begins AND NOT says").select("ekey").distinct()).withColumn("sign", F.lit(1)))
    total = reduce(DataFrame.unionByName, counts).groupBy("relationship_type", "confidence").agg(F.sum(F.col("n") * F.col("sign")).cast("long").alias("n"))
    return total.filter("n > 0")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*(F.col(c).alias(p + c) for c in rows.columns)) for p in ("a_", "b_"))


def _unresolved(pairs: DataFrame) -> DataFrame:
    """What ``classify`` says of pairs that lack context, and of those of different periods."""
    return pairs.select(F.lit("UNRESOLVED").alias("relationship_type"), F.lit(0.0).alias("confidence"), "n")


def _counted(found: DataFrame, *more: str) -> DataFrame:
    """relationship_type, confidence, n (exact) of pairs of rows with equal entity, metric and ``more``."""
    keys = ("ekey", "mkey", *more)
    flags = gates()
    clear = ~_any(flags[k][1] for k in ("unit", "scope", "geography"))
    says = F.col("a_says") | F.col("b_says")
    loose = ("canonical_unit", "unit_kind", "scope_key", "geography_key", "bounded", "says")
    period = ("norm_start", "norm_end")
    deciding = ("canonical_unit", "unit_kind", "scope_key", "geography_key", "says", "epistemic_status", "vintage_key", "vintage_label", "restates", "numeric_value", "resolution")
    any_period = _pairs_of_cells(found, keys, loose)
    surfaces = F.when(F.col("a_bounded") & F.col("b_bounded"), says).otherwise(clear)
    apart = _unresolved(any_period.filter(surfaces).agg(F.sum("met").alias("n")))
    equal = _pairs_of_cells(found.filter("bounded"), (*keys, *period), deciding)
    # What only explanations need is there to be named, and not read.
    equal = classify(compare(equal.withColumns({p + c: F.lit(None).cast("string") for p in ("a_", "b_") for c in CARRIED if p + c not in equal.columns})))
    equal = equal.groupBy("relationship_type", "confidence", clear.alias("clear"), says.alias("says")).agg(F.sum("met").alias("n"))
    equal = written(equal)  # as many rows as there are kinds
    # Among any periods those that are equal have been met too.
    off = _unresolved(equal.filter("says").select((-F.col("n")).alias("n")))
    both = equal.filter("clear").select("relationship_type", "confidence", "n").unionByName(apart).unionByName(off)
    # Each pair has been met from both sides.
    return both.groupBy("relationship_type", "confidence").agg((F.sum("n") / 2).cast("decimal(38,0)").alias("n")).filter("n IS NOT NULL")


def _pairs_of_cells(rows: DataFrame, keys: tuple[str, ...], cell: tuple[str, ...]) -> DataFrame:
    """Pairs (a_, b_) of cells with equal ``keys`` whose units agree, and ``met``: how often rows of them meet others."""
    # One number is dealt and sorted faster than several texts; it puts cells of a key together before they are counted.
    dealt = rows.select(F.xxhash64(*keys).alias("h"), *keys, *cell).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    a, b = _sides(dealt.groupBy("h", *keys, *cell).agg(F.count("*").alias("n")))
    same = lambda of: reduce(and_, (F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in of))
    equal = reduce(and_, (F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys))
    pairs = a.hint("merge").join(b, (F.col("a_h") == F.col("b_h")) & equal & units_agree())
    met = F.col("a_n").cast("decimal(19,0)") * F.col("b_n").cast("decimal(19,0)") - F.when(same(cell), F.col("a_n")).otherwise(0).cast("decimal(19,0)")
    return pairs.withColumn("met", met.cast("decimal(28,0)"))


def _repeated(facts: DataFrame, found: DataFrame, rows: DataFrame) -> list[tuple[DataFrame, tuple[str, ...], int]]:
    """Rows among which are all with the same id or place, by which keys they agree, and with what sign pairs count."""
    by_pos = F.xxhash64(F.lit("pos"), "ekey", "pos")
    often = written(rows.select(F.explode(F.array("id_hash", by_pos)).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    n = often.count()
    if not n:
        return []
    often = F.broadcast(often) if n <= MOST_HOT_KEYS else often
    of_pos = written(found.withColumn("h", by_pos).join(often, "h", "left_semi"))
    # The ids themselves are asked for only where hashes are equal.
    named = normalize_facts(facts).filter("pos IS NOT NULL AND fact_id IS NOT NULL AND ekey <> '' AND mkey <> ''").withColumn("h", id_hash())
    named = named.withColumns({"says": F.col("time_marks").bitwiseAND(SAYS_TIME) != 0, "bounded": F.col("norm_start").isNotNull() & F.col("norm_end").isNotNull()})
    of_id = written(named.join(often, "h", "left_semi").select("fact_id", *(c for c in found.columns if c in named.columns)))
    return [(of_id, ("fact_id",), -1), (of_pos, ("pos",), -1), (of_id, ("fact_id", "pos"), 1)]


def _across_texts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts of pairs of different periods whose texts compare times together, and neither by itself."""
    kept = ("pos", "fact_id", "ekey", "mkey", "norm_start", "norm_end", "unit_kind", "time_marks", "evidence")
    rows = written(normalize_facts(facts).join(entities, "ekey", "left_semi").select(*kept))
    rows = rows.filter("mkey <> '' AND norm_start IS NOT NULL AND norm_end IS NOT NULL").filter(F.col("time_marks").bitwiseAND(SAYS_TIME) == 0)
    bit, years = lambda b: F.col("time_marks").bitwiseAND(b) != 0, F.shiftright("time_marks", 3)
    free = bit(OPENS_TIME) | (bit(SAYS_WAS) & (years >= 1))
    one = (F.col("a_ekey") == F.col("b_ekey")) & (F.col("a_mkey") == F.col("b_mkey")) & ((F.col("a_norm_start") != F.col("b_norm_start")) | (F.col("a_norm_end") != F.col("b_norm_end")))
    on = one & (F.col("a_pos") < F.col("b_pos")) & (F.col("a_fact_id") != F.col("b_fact_id")) & units_agree() & temporal_language()
    sides = ((rows.filter(free), rows), (rows.filter(~free & bit(SAYS_WAS)), rows.filter(years >= 2)))
    counts = [_sides(x)[0].hint("merge").join(_sides(y)[1], on).agg(F.count("*").cast("decimal(38,0)").alias("n")) for x, y in sides]
    return _unresolved(counts[0].unionByName(counts[1]))

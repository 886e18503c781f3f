"""Normalisation of values, units, periods, entities and metrics as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import blank, collapse, let, strip


def _like(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit("(?i)" + pattern))


def _first(*cases: tuple[Column, Column | str], default: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if default is None else out.otherwise(default)


def qualifier(raw: Column) -> Column:
    return let(strip(raw), _qualifier)


def _qualifier(x: Column) -> Column:
    low = F.lower(x)
    return _first(
        *((F.startswith(x, F.lit(s)), F.lit(q)) for s, q in V.QUALIFIER_SYMBOLS),
        (F.startswith(x, F.lit("+")) | F.endswith(x, F.lit("+")), F.lit(">=")),
        (F.startswith(x, F.lit("~")), F.lit("~")),
        *((F.startswith(low, F.lit(s)), F.lit(q)) for s, q in V.QUALIFIER_WORDS),
    )


def number(raw: Column) -> Column:
    """The number in a raw value as an exact decimal, or null."""
    kept = F.regexp_replace(F.regexp_replace(raw, V.DASHES, "-"), r"[^0-9.\-+]", "")
    return F.regexp_replace(kept, r"^\++|\++$", "").try_cast("decimal(24,8)")


def semantic_unit(unit: Column) -> Column:
    """The words of a unit that are neither scales nor currencies nor say a decline; null if none."""
    words = F.transform(F.regexp_extract_all(F.coalesce(unit, F.lit("")), F.lit("[a-zA-Z]+"), F.lit(0)), F.lower)
    kept = F.filter(words, lambda w: ~w.isin(*V.SCALE_OF_TOKEN, *V.CURRENCY_WORDS) & ~F.regexp_like(w, F.lit(rf"^{V.DECLINE}$")))
    return let(F.array_join(kept, " "), lambda said: F.when(said != "", said))


def scale(combined: Column) -> Column:
    """The scale said by the first token that says one."""
    tokens = F.regexp_extract_all(combined, F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*(F.lit(x) for pair in V.SCALE_OF_TOKEN.items() for x in pair))
    return F.try_element_at(table, F.try_element_at(F.filter(tokens, lambda t: t.isin(*V.SCALE_OF_TOKEN)), F.lit(1)))


def power_of_ten(label: Column) -> Column:
    """A scale's multiplier, exactly; 1 for none."""
    return _first(*((label == k, F.lit(10**p).cast("decimal(13,0)")) for k, (p, _) in V.SCALES.items()), default=F.lit(1).cast("decimal(13,0)"))


def value(raw: Column, unit: Column, numeric: Column) -> Column:
    """numeric_value, canonical_unit, scale, value_qualifier, currency, status and note of a raw value.

    What several of these ask for is bound once, since patterns cost far more than all else.
    """
    combined = F.lower(strip(F.concat(raw, F.lit(" "), F.coalesce(unit, F.lit("")))))
    num = F.coalesce(number(raw), numeric.try_cast("decimal(24,8)"))

    def told(x: Column) -> Column:
        said = x["combined"]
        down = F.coalesce(numeric < 0, F.lit(False)) | F.regexp_like(said, F.lit(rf"\b{V.DECLINE}\b"))
        currency = _first(*((F.regexp_like(said, F.lit(p)), F.lit(code)) for code, p in V.CURRENCIES.items()))
        return F.struct(
            said.alias("combined"),
            F.when((x["num"] > 0) & down, -x["num"]).otherwise(x["num"]).alias("num"),
            F.regexp_like(said, F.lit(V.PERCENT)).alias("percent"),
            currency.alias("currency"),
            scale(said).alias("label"),
        )

    def fields(x: Column) -> Column:
        num, percent, currency, label = x["num"], x["percent"], x["currency"], x["label"]
        dollar = currency.isNull() & F.contains(x["combined"], F.lit("$"))
        some = num.isNotNull()
        plain = some & ~percent
        return F.struct(
            F.when(percent, num.cast("double")).otherwise((num * power_of_ten(label)).cast("double")).alias("numeric_value"),
            _first(
                (~some, F.lit(None).cast("string")),
                (percent, F.lit("percent")),
                (currency.isNotNull(), currency),
                (dollar, F.lit(None).cast("string")),
                default=F.coalesce(semantic_unit(unit), semantic_unit(raw), F.lit("count")),
            ).alias("canonical_unit"),
            F.when(plain, label).alias("scale"),
            qualifier(raw).alias("value_qualifier"),
            F.when(plain, currency).alias("currency"),
            _first((~some, F.lit("unresolved")), (~percent & dollar, F.lit("partial")), default=F.lit("normalized")).alias("status"),
            _first(
                (percent & some, F.lit(V.NOTE_PERCENT)),
                (percent, F.lit(V.NOTE_NO_PERCENT)),
                (~some, F.lit(V.NOTE_NO_NUMBER)),
                (dollar, F.lit(V.NOTE_DOLLAR)),
            ).alias("note"),
        )

    return let(let(F.struct(combined.alias("combined"), num.alias("num")), told), fields)


def _year(digits: Column) -> Column:
    """Two digits are a year of this century."""
    n = digits.cast("int")
    return F.lpad(F.when(n < 100, n + 2000).otherwise(n).cast("string"), 4, "0")


def _quarter(q: Column, start: Column, end: Column) -> tuple[Column, Column]:
    part = lambda *days: _first(*((q == str(i + 1), F.concat(end if i == 3 else start, F.lit(d))) for i, d in enumerate(days)))
    return part("-04-01", "-07-01", "-10-01", "-01-01"), part("-06-30", "-09-30", "-12-31", "-03-31")


def period(label: Column, calendar: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """start, end and warning of a period label; ``calendar`` may say that years run from April to March."""
    none = F.lit(None).cast("string")
    start, end = (none if start is None else start), (none if end is None else end)
    april = F.coalesce((none if calendar is None else calendar) == "april-march", F.lit(False))
    return let(strip(F.coalesce(label, F.lit(""))), lambda raw: _period(raw, april, start, end))


def _period(raw: Column, april: Column, start: Column, end: Column) -> Column:
    """``period`` of a stripped label."""
    none = F.lit(None).cast("string")
    part = lambda p, i: F.regexp_extract(raw, "(?i)" + p, i)
    result = lambda a, b, w=none: F.struct(a.alias("start"), b.alias("end"), w.alias("warning"))
    month = F.create_map(*(F.lit(x) for pair in V.MONTH_NUMBER.items() for x in pair))

    iso = V.DAY_ISO
    on = F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))
    by_month = V.DAY_MONTH_FIRST
    by_day = V.DAY_DAY_FIRST
    m1, m2 = F.try_element_at(month, F.lower(part(by_month, 1))), F.try_element_at(month, F.lower(part(by_day, 2)))
    d1 = F.concat_ws("-", part(by_month, 3), m1, F.lpad(part(by_month, 2), 2, "0"))
    d2 = F.concat_ws("-", part(by_day, 3), m2, F.lpad(part(by_day, 1), 2, "0"))
    cy = V.YEAR_CALENDAR
    span = V.YEAR_SPAN
    q_span = V.QUARTER_SPAN
    q_bare = V.QUARTER_BARE
    fy = V.YEAR_FISCAL
    year = lambda p, i: _year(part(p, i))
    before = lambda p, i: F.lpad((year(p, i).cast("int") - 1).cast("string"), 4, "0")
    unclear_q = F.concat(F.lit("Fiscal quarter '"), raw, F.lit("' convention not explicitly established (requires April-March context)."))
    unclear_y = F.concat(F.lit("Fiscal-year convention not explicitly established for bare label '"), raw, F.lit("'."))
    return _first(
        ((F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != ""), result(start, end)),
        (raw == "", result(none, none, F.lit("Empty temporal label."))),
        (_like(raw, iso), result(on, on)),
        (_like(raw, by_month) & m1.isNotNull(), result(d1, d1)),
        (_like(raw, by_day) & m2.isNotNull(), result(d2, d2)),
        (_like(raw, cy), result(F.concat(part(cy, 1), F.lit("-01-01")), F.concat(part(cy, 1), F.lit("-12-31")))),
        (_like(raw, span), result(F.concat(part(span, 1), F.lit("-04-01")), F.concat(year(span, 2), F.lit("-03-31")))),
        (_like(raw, q_span), result(*_quarter(part(q_span, 1), part(q_span, 2), year(q_span, 3)))),
        (_like(raw, q_bare) & april, result(*_quarter(part(q_bare, 1), before(q_bare, 2), year(q_bare, 2)))),
        (_like(raw, q_bare), result(none, none, unclear_q)),
        (_like(raw, fy) & april, result(F.concat(before(fy, 1), F.lit("-04-01")), F.concat(year(fy, 1), F.lit("-03-31")))),
        (_like(raw, fy), result(none, none, unclear_y)),
        (_like(raw, r"^\d{4}$"), result(F.concat(raw, F.lit("-01-01")), F.concat(raw, F.lit("-12-31")))),
        default=result(none, none, F.concat(F.lit("Unresolvable temporal label: '"), raw, F.lit("'."))),
    )


def entity(raw: Column) -> Column:
    """White space collapsed and one legal suffix dropped, with commas and full stops at the end."""
    clean = collapse(F.coalesce(raw, F.lit("")))
    base = F.regexp_replace(F.trim(F.regexp_replace(clean, "(?i)" + V.LEGAL_SUFFIX, "")), r"[,. ]+$", "")
    return F.when(base == "", clean).otherwise(base)


def metric(raw: Column) -> Column:
    return F.lower(collapse(F.coalesce(raw, F.lit(""))))


def signature(*parts: Column) -> Column:
    """One lower-case key of a claim's coordinates."""
    return F.lower(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


__all__ = ["blank", "entity", "metric", "number", "period", "power_of_ten", "qualifier", "scale", "semantic_unit", "signature", "value"]

"""DuckDB SQL that the engine's queries are held against.

The SQL shares vocabularies and patterns with the engine and nothing else: windows are found by
gaps and islands, pairs by plain self-joins, overlaps pair by pair. ``\\b`` knows ASCII letters only
there, so accented letters are turned into underscores before such patterns run.
"""

from __future__ import annotations

from ..functions import vocab as V

SP = V.SPACE_RE2


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '[À-ÖØ-öø-ÿ]', '_', 'g')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def numbers(x: str) -> str:
    return f"list_transform(list_filter({every(x, V.NUMBER)}, lambda n: regexp_matches(n, '[0-9]')), lambda n: {strip('n')})"


def tokens(x: str, pattern: str, lower: bool = False) -> str:
    t = f"lower({strip('t')})" if lower else strip("t")
    return f"list_sort(list_distinct(list_transform({every(plain(x), '(?i)' + pattern)}, lambda t: {t})))"


def bar(xs: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({xs}, {q(sep)}), '')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def ladder(x: str, steps, default: str | None) -> str:
    cases = " ".join(f"WHEN {any_of(x, words)} THEN {q(v)}" for words, v in steps)
    return f"CASE {cases} ELSE {'NULL' if default is None else q(default)} END"


def round_even(x: str, n: int) -> str:
    return f"round_even({x}, {n})"


# -- views ------------------------------------------------------------------------------------------

PAGES = f"""pages_v AS (
  SELECT *, length(text)::INT AS char_count, (text IS NOT NULL AND {strip('text')} <> '') AS has_text FROM (
    SELECT source AS document_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id))::INT AS page_number, doc_id, text FROM documents))"""

LINES = PAGES + f""", arr AS (
  SELECT *, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END AS lines
  FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '{V.LINE_BREAK_RE2}') AS ls FROM pages_v)), lines_v AS (
  SELECT document_id, page_number, doc_id, has_text, len(lines) AS total, unnest(range(len(lines)))::INT AS line_no, unnest(lines) AS raw FROM arr)"""

#: Tagged lines and those that bear facts.
REGIONS = LINES + f""", tagged AS (
  SELECT *, {plain('line')} AS p, {numbers('line')} AS nums FROM (SELECT *, {strip('raw')} AS line FROM lines_v) WHERE line <> ''), signs AS (
  SELECT *, {every('p', '(?i)' + V.CURRENCY)} AS cur, {every('p', '(?i)' + V.LINE_UNIT)} AS uni, {every('p', '(?i)' + V.LINE_METRIC)} AS met,
    {every('p', '(?i)' + V.LINE_TIME)} AS tim, {every('p', '(?i)' + V.YEAR_COLUMN)} AS yrs, contains(line, '%') AS pct FROM tagged), marked AS (
  SELECT *, list_filter([CASE WHEN len(nums) > 0 THEN 'numeric' END, CASE WHEN len(cur) > 0 THEN 'currency' END, CASE WHEN len(uni) > 0 THEN 'unit' END,
      CASE WHEN pct THEN 'percentage' END, CASE WHEN len(met) > 0 THEN 'metric_keyword' END, CASE WHEN len(tim) > 0 THEN 'temporal' END,
      CASE WHEN len(nums) >= 2 OR len(yrs) >= 2 THEN 'table_row' END], lambda t: t IS NOT NULL) AS signals,
    list_concat(list_concat(list_concat(list_concat(nums[1:3], list_transform(cur[1:2], lambda t: {strip('t')})), list_transform(uni[1:2], lambda t: {strip('t')})),
      list_transform(met[1:2], lambda t: {strip('t')})), list_transform(tim[1:2], lambda t: {strip('t')})) AS anchors FROM signs), regions AS (
  SELECT document_id, page_number, total, line_no, line, signals,
    CASE WHEN len(anchors) > 0 THEN array_to_string(anchors[1:3], ', ') ELSE substr(line, 1, 30) END AS anchor_text
  FROM marked WHERE (len(nums) > 0 OR pct) AND (len(cur) > 0 OR len(uni) > 0 OR pct OR len(met) > 0 OR len(tim) > 0 OR len(nums) >= 2 OR len(yrs) >= 2
    OR (len(anchors) > 0 AND (regexp_matches(line, '[0-9]{{2}}') OR contains(line, '%') OR contains(line, '+')))))"""


def windows(radius: str = "2", base: str = "regions", extra: str = "") -> str:
    """Windows by gaps and islands."""
    return f""", spans AS (
  SELECT *, greatest(0, line_no - {radius}) AS s, least(total - 1, line_no + {radius}) AS e FROM {base}), flagged AS (
  SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY document_id, page_number{extra} ORDER BY line_no) + 3 THEN 0 ELSE 1 END AS fresh FROM spans), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY document_id, page_number{extra} ORDER BY line_no) AS island FROM flagged), wins AS (
  SELECT document_id, page_number{extra}, island, CASE WHEN island = 1 AND min(s) <= 3 THEN 0 ELSE min(s) END::INT AS start_line, max(e)::INT AS end_line,
    list_sort(list_distinct(list(anchor_text))) AS anchors, list_sort(list_distinct(flatten(list(signals)))) AS signals FROM islands GROUP BY document_id, page_number{extra}, island)"""


WINDOWS = REGIONS + windows() + """, wtext AS (
  SELECT w.*, array_to_string(a.lines[start_line + 1:end_line + 1], chr(10)) AS source_text FROM wins w JOIN arr a USING (document_id, page_number))"""

CONTEXT = WINDOWS + """, ctx AS (
  SELECT p.document_id, p.page_number, p.doc_id, p.text, p.has_text, CASE WHEN p.has_text THEN length(p.text) ELSE 0 END::INT AS original_chars,
    coalesce(sum(length(w.source_text)), 0)::INT AS selected_chars, count(w.island)::INT AS n_windows,
    coalesce(array_to_string(list_sort(list_distinct(flatten(list(w.signals) FILTER (w.island IS NOT NULL)))), '|'), '') AS signals,
    coalesce(string_agg(w.source_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY w.island), '') AS combined_text,
    list(length(w.source_text)) FILTER (w.island IS NOT NULL) AS sizes
  FROM pages_v p LEFT JOIN wtext w USING (document_id, page_number) GROUP BY ALL), prompts AS (
  SELECT *, CASE WHEN n_windows = 0 THEN text ELSE combined_text END AS prompt_text FROM ctx)"""

#: Scores in hundredths.
SCORES = LINES + f""", tabular AS (
  SELECT document_id, page_number, count(*) AS n FROM (SELECT *, {strip('raw')} AS line FROM lines_v)
  WHERE len({numbers('line')}) >= 2 AND len(regexp_split_to_array(line, '{SP}+')) >= 3 GROUP BY ALL), sig AS (
  SELECT p.*, coalesce(t.n, 0)::INT AS table_rows, {numbers('text')} AS nums, {tokens('text', V.CURRENCY)} AS currencies, {tokens('text', V.PAGE_UNIT, True)} AS units,
    {tokens('text', V.PAGE_METRIC, True)} AS metrics, {tokens('text', V.PAGE_TIME)} AS temporals, {tokens('text', V.BOILERPLATE, True)} AS boilerplates
  FROM pages_v p LEFT JOIN tabular t USING (document_id, page_number)), near AS (
  SELECT *, coalesce(lag(len(metrics) > 0 AND has_text) OVER w, false) OR coalesce(lead(len(metrics) > 0 AND has_text) OVER w, false) AS beside
  FROM sig WINDOW w AS (PARTITION BY document_id ORDER BY page_number)), points AS (
  SELECT *, least(5 * len(nums), 30) AS p1, least(15 * len(currencies), 25) AS p2, least(10 * len(units), 20) AS p3, least(10 * len(metrics), 25) AS p4,
    CASE WHEN table_rows >= 3 THEN 15 ELSE least(5 * table_rows, 10) END AS p5, least(5 * len(temporals), 10) AS p6,
    CASE WHEN len(nums) >= 2 AND len(metrics) = 0 AND beside THEN 5 ELSE 0 END AS p7,
    CASE WHEN len(boilerplates) > 0 AND len(currencies) = 0 AND len(metrics) = 0 AND len(nums) <= 4 THEN -30 ELSE 0 END AS p8 FROM near), scored AS (
  SELECT *, CASE WHEN has_text THEN greatest(0, least(100, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8)) ELSE 0 END::INT AS h FROM points)"""


def plan(budget: int = 3, size: int = 5, source: str = "SELECT document_id, page_number, h / 100 AS score FROM scored WHERE has_text") -> str:
    return f""", elig AS ({source}), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY document_id) AS n_eligible, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, page_number) AS r FROM elig), took AS (
  SELECT *, r <= {budget * size} AS planned FROM ranked), plan_v AS (
  SELECT document_id, page_number, n_eligible, planned, CASE WHEN planned THEN (sum(planned::INT) OVER (PARTITION BY document_id ORDER BY page_number) - 1) // {size} END::INT AS batch_id FROM took)"""


REPORTS = "(VALUES (0, 'annual-report'), (1, 'presentation'), (2, 'press-note')) AS rep(r, document_id)"
FACT_ID = "'fact-' || substr(sha256(concat_ws('|', {d}, {p}, {e}, {m}, {v}, {l})), 1, 16)"


def claims(by: str = "nation") -> str:
    name = ("n_nationkey", "n_name") if by == "nation" else ("c_custkey", "c_name")
    tail = " ".join(("JOIN nation ON c_nationkey = n_nationkey",)) if by == "nation" else ""
    fid = FACT_ID.format(d="document_id", p="page_number", e="entity", m="metric", v="value_raw", l="period_label")
    return f"""sums AS (
  SELECT {name[0]} AS k, {name[1]} AS name, year(o_orderdate) AS y, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey {tail} GROUP BY ALL), grid AS (
  SELECT *, k % 5 AS k5, (c + 50000000) // 100000000 AS cr, (CASE WHEN k % 5 = 1 THEN c + c // 5 ELSE c END + 500000) // 1000000 AS mi
  FROM sums, {REPORTS}, (VALUES (0), (1), (2), (3)) AS kinds(kind)), said AS (
  SELECT *, CASE WHEN kind IN (0, 3) THEN CASE WHEN r = 0 THEN '₹' || cr // 10 || '.' || cr % 10 || ' crore' ELSE '₹' || mi // 100 || '.' || lpad((mi % 100)::VARCHAR, 2, '0') || ' million' END
      WHEN kind = 1 THEN n || CASE WHEN r = 2 THEN '+' ELSE '' END || ' orders' ELSE n % 17 || '.' || n % 10 || '%' END AS value_raw,
    CASE WHEN kind IN (0, 3) THEN 'Order Value' WHEN kind = 1 THEN CASE WHEN r = 1 THEN 'Number of orders' ELSE 'Order  Count' END
      ELSE CASE WHEN r = 0 THEN 'total order value growth' ELSE 'Order value growth' END END AS metric,
    CASE WHEN kind = 3 THEN 'FY' ELSE 'FY ' || y || '-' END || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS period_label,
    name || CASE r WHEN 0 THEN ' Limited' WHEN 1 THEN ' Ltd.' ELSE '' END AS entity FROM grid), claims_0 AS (
  SELECT r::BIGINT * 1000000000 + k * 1000 + (y - 1970) * 4 + kind AS pos, document_id, (k + 1)::INT AS page_number, entity, metric, value_raw, NULL::DOUBLE AS value_numeric,
    CASE WHEN kind = 2 THEN 'percent' WHEN kind = 1 AND r = 1 THEN 'orders' END AS unit, period_label, CASE WHEN k5 = 2 AND r = 1 THEN 'Consolidated' END AS scope,
    CASE WHEN k % 11 = 4 THEN CASE WHEN r = 0 THEN 'Asia' ELSE 'World' END END AS geography, CASE WHEN k5 = 4 AND r = 1 THEN 'target' ELSE 'reported' END AS epistemic_status,
    CASE WHEN k5 = 3 THEN CASE r WHEN 0 THEN 'First Advance Estimate' WHEN 1 THEN 'Second Advance Estimate' ELSE 'Flash' END END AS data_vintage,
    metric || ' of ' || entity || ' was ' || value_raw || ' in ' || period_label || CASE WHEN k5 = 0 AND y % 3 = 0 AND r = 2 THEN ', as restated'
      WHEN k % 7 = 3 AND r = 1 THEN ', compared to the year before' ELSE '' END || '.' AS supporting_text FROM said), claims_v AS (
  SELECT *, {fid} AS fact_id FROM claims_0)"""


# -- normalisation ----------------------------------------------------------------------------------


def number(x: str) -> str:
    kept = f"regexp_replace(regexp_replace({x}, '{V.DASHES_RE2}', '-', 'g'), '[^0-9.\\-+]', '', 'g')"
    return f"TRY_CAST(regexp_replace(regexp_replace({kept}, '^\\++', ''), '\\++$', '') AS DECIMAL(24,8))"


def numeric_candidate(x: str) -> str:
    bare = strip(f"regexp_replace({x}, '₹|\\$|Rs\\.|INR|USD|[><~%]', '', 'g')")
    words = r"(?i)\b(?:Cr(?:ore)?|Mn|Million|Bn|Billion|Lakh|tonnes?|shipments?|customers?)\b"
    rest = f"replace(regexp_replace({bare}, {q(words)}, '', 'g'), ',', '')"
    return f"TRY_CAST({strip(rest)} AS DOUBLE)"


def qualifier(x: str) -> str:
    s = strip(x)
    cases = [f"WHEN starts_with({s}, {q(a)}) THEN {q(b)}" for a, b in V.QUALIFIER_SYMBOLS]
    cases += [f"WHEN starts_with({s}, '+') OR ends_with({s}, '+') THEN '>='", f"WHEN starts_with({s}, '~') THEN '~'"]
    cases += [f"WHEN starts_with(lower({s}), {q(a)}) THEN {q(b)}" for a, b in V.QUALIFIER_WORDS]
    return f"CASE {' '.join(cases)} END"


def _list(words) -> str:
    return ", ".join(q(w) for w in words)


def semantic(x: str) -> str:
    words = f"list_transform(regexp_extract_all(coalesce({x}, ''), '[a-zA-Z]+'), lambda w: lower(w))"
    kept = f"list_filter({words}, lambda w: w NOT IN ({_list((*V.SCALE_OF_TOKEN, *V.CURRENCY_WORDS))}) AND NOT regexp_full_match(w, {q(V.DECLINE)}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') END"


def values(source: str, keep: str = "*") -> str:
    """CTEs val_1 .. val_v over rows with value_raw, unit and value_numeric."""
    scale = "CASE " + " ".join(f"WHEN token IN ({_list(ts)}) THEN {q(k)}" for k, (_, ts) in V.SCALES.items()) + " END"
    power = "CASE scale_0 " + " ".join(f"WHEN {q(k)} THEN {10**p}" for k, (p, _) in V.SCALES.items()) + " ELSE 1 END"
    money = "CASE " + " ".join(f"WHEN {matches('comb', p)} THEN {q(k)}" for k, p in V.CURRENCIES.items()) + " END"
    return f"""val_1 AS (
  SELECT *, lower({strip("value_raw || ' ' || coalesce(unit, '')")}) AS comb, coalesce({number('value_raw')}, TRY_CAST(value_numeric AS DECIMAL(24,8))) AS num_0 FROM {source}), val_2 AS (
  SELECT *, list_filter(regexp_extract_all(comb, '[a-z]+'), lambda t: t IN ({_list(V.SCALE_OF_TOKEN)}))[1] AS token, {money} AS cur_0, {matches('comb', V.PERCENT)} AS pct,
    {matches('comb', chr(92) + 'b' + V.DECLINE + chr(92) + 'b')} OR coalesce(value_numeric < 0, false) AS down FROM val_1), val_3 AS (
  SELECT *, {scale} AS scale_0, CASE WHEN down AND num_0 > 0 THEN -num_0 ELSE num_0 END AS num, cur_0 IS NULL AND contains(comb, '$') AS dollar FROM val_2), val_v AS (
  SELECT *, CASE WHEN pct THEN num::DOUBLE ELSE (num * {power})::DOUBLE END AS numeric_value,
    CASE WHEN num IS NULL THEN NULL WHEN pct THEN 'percent' WHEN cur_0 IS NOT NULL THEN cur_0 WHEN dollar THEN NULL ELSE coalesce({semantic('unit')}, {semantic('value_raw')}, 'count') END AS canonical_unit,
    CASE WHEN num IS NOT NULL AND NOT pct THEN scale_0 END AS scale, {qualifier('value_raw')} AS value_qualifier, CASE WHEN num IS NOT NULL AND NOT pct THEN cur_0 END AS currency,
    CASE WHEN num IS NULL THEN 'unresolved' WHEN NOT pct AND dollar THEN 'partial' ELSE 'normalized' END AS status,
    CASE WHEN pct AND num IS NOT NULL THEN {q(V.NOTE_PERCENT)} WHEN pct THEN {q(V.NOTE_NO_PERCENT)} WHEN num IS NULL THEN {q(V.NOTE_NO_NUMBER)} WHEN dollar THEN {q(V.NOTE_DOLLAR)} END AS note FROM val_3)"""


def periods(source: str, calendar: str = "NULL") -> str:
    """CTE per_v over rows with a label: start, end, warning."""
    ex = lambda p, i: f"regexp_extract(raw, {q('(?i)' + p)}, {i})"
    has = lambda p: matches("raw", "(?i)" + p)
    month = lambda x: "CASE lower(" + x + ") " + " ".join(f"WHEN {q(n)} THEN {q(k)}" for n, k in V.MONTH_NUMBER.items()) + " END"
    year = lambda x: f"lpad((CASE WHEN TRY_CAST({x} AS INT) < 100 THEN TRY_CAST({x} AS INT) + 2000 ELSE TRY_CAST({x} AS INT) END)::VARCHAR, 4, '0')"
    last = lambda x: f"lpad((TRY_CAST({year(x)} AS INT) - 1)::VARCHAR, 4, '0')"
    iso = V.DAY_ISO
    md = V.DAY_MONTH_FIRST
    dm = V.DAY_DAY_FIRST
    cy, span = V.YEAR_CALENDAR, V.YEAR_SPAN
    qs, qb, fy = V.QUARTER_SPAN, V.QUARTER_BARE, V.YEAR_FISCAL
    april = f"coalesce({calendar} = 'april-march', false)"

    def quarter(n: str, a: str, b: str) -> tuple[str, str]:
        return (
            f"CASE {n} WHEN '1' THEN {a} || '-04-01' WHEN '2' THEN {a} || '-07-01' WHEN '3' THEN {a} || '-10-01' ELSE {b} || '-01-01' END",
            f"CASE {n} WHEN '1' THEN {a} || '-06-30' WHEN '2' THEN {a} || '-09-30' WHEN '3' THEN {a} || '-12-31' ELSE {b} || '-03-31' END",
        )

    d_iso = f"concat_ws('-', {ex(iso, 1)}, {ex(iso, 2)}, {ex(iso, 3)})"
    d_md = f"concat_ws('-', {ex(md, 3)}, {month(ex(md, 1))}, lpad({ex(md, 2)}, 2, '0'))"
    d_dm = f"concat_ws('-', {ex(dm, 3)}, {month(ex(dm, 2))}, lpad({ex(dm, 1)}, 2, '0'))"
    cases = [
        ("raw = ''", "NULL", "NULL", "'Empty temporal label.'"),
        (has(iso), d_iso, d_iso, "NULL"),
        (f"{has(md)} AND {month(ex(md, 1))} IS NOT NULL", d_md, d_md, "NULL"),
        (f"{has(dm)} AND {month(ex(dm, 2))} IS NOT NULL", d_dm, d_dm, "NULL"),
        (has(cy), f"{ex(cy, 1)} || '-01-01'", f"{ex(cy, 1)} || '-12-31'", "NULL"),
        (has(span), f"{ex(span, 1)} || '-04-01'", f"{year(ex(span, 2))} || '-03-31'", "NULL"),
        (has(qs), *quarter(ex(qs, 1), ex(qs, 2), year(ex(qs, 3))), "NULL"),
        (f"{has(qb)} AND {april}", *quarter(ex(qb, 1), last(ex(qb, 2)), year(ex(qb, 2))), "NULL"),
        (has(qb), "NULL", "NULL", "'Fiscal quarter ''' || raw || ''' convention not explicitly established (requires April-March context).'"),
        (f"{has(fy)} AND {april}", f"{last(ex(fy, 1))} || '-04-01'", f"{year(ex(fy, 1))} || '-03-31'", "NULL"),
        (has(fy), "NULL", "NULL", "'Fiscal-year convention not explicitly established for bare label ''' || raw || '''.'"),
        (has(r"^\d{4}$"), "raw || '-01-01'", "raw || '-12-31'", "NULL"),
    ]
    pick = lambda i, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + f" ELSE {other} END"
    return f"""per_0 AS (SELECT *, {strip("coalesce(period_label, '')")} AS raw FROM {source}), per_v AS (
  SELECT *, {pick(1, 'NULL')} AS norm_start, {pick(2, 'NULL')} AS norm_end, {pick(3, "'Unresolvable temporal label: ''' || raw || '''.'")} AS warning FROM per_0)"""


def entity(x: str) -> str:
    clean = collapse(f"coalesce({x}, '')")
    base = f"regexp_replace(trim(regexp_replace({clean}, {q('(?i)' + V.LEGAL_SUFFIX)}, '')), '[,. ]+$', '')"
    return f"CASE WHEN {base} = '' THEN {clean} ELSE {base} END"


def metric(x: str) -> str:
    return f"lower({collapse('coalesce(' + x + ', ' + q('') + ')')})"


RES = "(10.0 ** -length(coalesce(string_split(regexp_replace(regexp_replace({v}, '[^0-9.\\-+]', '', 'g'), '^\\++', ''), '.')[2], ''))) * (CASE {s} " + " ".join(f"WHEN {q(k)} THEN {10**p}" for k, (p, _) in V.SCALES.items()) + " ELSE 1 END)"


def facts(by: str = "nation") -> str:
    low = lambda c: f"CASE WHEN {c} <> '' THEN lower({strip(c)}) END"
    return f"""{claims(by)}, {periods('claims_v')}, {values('per_v')}, facts_v AS (
  SELECT * REPLACE (CASE WHEN norm_start IS NOT NULL AND norm_end IS NOT NULL THEN norm_start END AS norm_start, CASE WHEN norm_start IS NOT NULL AND norm_end IS NOT NULL THEN norm_end END AS norm_end),
    {entity('entity')} AS canonical_entity, {metric('metric')} AS canonical_metric, lower({strip(entity('entity'))}) AS ekey, {metric('metric')} AS mkey,
    {low('scope')} AS sk, {low('geography')} AS gk, {low('data_vintage')} AS vk, {RES.format(v='value_raw', s='scale')} AS resolution,
    canonical_unit = 'percent' AS is_pct, lower(canonical_unit) IN ({_list(V.CURRENCY_UNITS)}) OR currency IS NOT NULL AS is_money, coalesce(canonical_unit, '') IN ('', 'count') AS is_free FROM val_v)"""


UNITS_AGREE = "(a.is_free OR b.is_free OR NOT ((a.is_money AND b.is_pct) OR (a.is_pct AND b.is_money)))"


def temporal(a: str, b: str) -> str:
    x, y = f"lower({strip(a)})", f"lower({strip(b)})"
    phrases = [f"contains({s}, {q(p)})" for s in (x, y) for p in V.TEMPORAL_PHRASES]
    both = plain(f"{x} || ' ' || {y}")
    return "(" + " OR ".join(phrases + [matches(both, p) for p in V.TEMPORAL_PATTERNS]) + ")"


def compared(by: str = "nation", on: str = "a.ekey = b.ekey AND a.mkey = b.mkey") -> str:
    def free(k: str, name: str) -> str:
        return f"CASE WHEN a.{k} <> '' AND b.{k} <> '' THEN CASE WHEN a.{k} <> b.{k} THEN '{name}_MISMATCH' END WHEN a.{k} IS DISTINCT FROM b.{k} THEN 'MISSING_{name}' END"

    def free_dim(k: str) -> str:
        return (
            f"CASE WHEN a.{k} <> '' AND b.{k} <> '' THEN CASE WHEN a.{k} = b.{k} THEN 'compatible (''' || a.{k} || ''')' ELSE 'mismatch (''' || a.{k} || ''' != ''' || b.{k} || ''')' END "
            f"WHEN a.{k} IS DISTINCT FROM b.{k} THEN 'unspecified on one claim (fact_a=''' || coalesce(a.{k}, 'None') || ''', fact_b=''' || coalesce(b.{k}, 'None') || ''')' ELSE 'compatible (both unspecified)' END"
        )

    return f"""{facts(by)}, coded AS (
  SELECT a.pos AS a_pos, b.pos AS b_pos, a.fact_id AS a_fact_id, b.fact_id AS b_fact_id, a AS fa, b AS fb,
    CASE WHEN a.mkey <> b.mkey THEN 'METRIC_MISMATCH' END AS c_met,
    CASE WHEN coalesce(a.canonical_unit, '') = '' OR coalesce(b.canonical_unit, '') = '' THEN 'MISSING_UNIT' WHEN a.canonical_unit <> b.canonical_unit THEN 'UNIT_MISMATCH' END AS c_uni,
    CASE WHEN a.norm_start IS NULL OR b.norm_start IS NULL THEN 'MISSING_TIME_PERIOD' WHEN a.norm_start <> b.norm_start OR a.norm_end IS DISTINCT FROM b.norm_end THEN 'TIME_MISMATCH' END AS c_tim,
    {free('sk', 'SCOPE')} AS c_sco, {free('gk', 'GEOGRAPHY')} AS c_geo, CASE WHEN a.epistemic_status <> b.epistemic_status THEN 'EPISTEMIC_STATUS_DIFFERENCE' END AS c_epi,
    CASE WHEN a.vk <> '' AND b.vk <> '' AND a.vk <> b.vk THEN 'DATA_VINTAGE_DIFFERENCE' END AS c_vin,
    CASE WHEN coalesce(a.canonical_unit, '') = '' OR coalesce(b.canonical_unit, '') = '' THEN 'unresolved unit (fact_a=''' || coalesce(a.canonical_unit, 'None') || ''', fact_b=''' || coalesce(b.canonical_unit, 'None') || ''')'
      WHEN a.canonical_unit <> b.canonical_unit THEN 'mismatch (''' || a.canonical_unit || ''' != ''' || b.canonical_unit || ''')' ELSE 'compatible (''' || a.canonical_unit || ''')' END AS dim_unit,
    CASE WHEN a.norm_start IS NULL OR b.norm_start IS NULL THEN 'unresolved interval' WHEN a.norm_start = b.norm_start AND a.norm_end = b.norm_end THEN 'compatible (' || a.norm_start || ' to ' || a.norm_end || ')'
      ELSE 'mismatch (' || a.norm_start || '..' || a.norm_end || ' vs ' || b.norm_start || '..' || b.norm_end || ')' END AS dim_time_period,
    {free_dim('sk')} AS dim_scope, {free_dim('gk')} AS dim_geography,
    CASE WHEN a.epistemic_status <> b.epistemic_status THEN 'differs (''' || a.epistemic_status || ''' vs ''' || b.epistemic_status || ''')' ELSE 'matching (''' || a.epistemic_status || ''')' END AS dim_epistemic_status,
    CASE WHEN a.vk <> '' AND b.vk <> '' AND a.vk <> b.vk THEN 'differs (''' || a.vk || ''' vs ''' || b.vk || ''')' ELSE 'compatible / unspecified' END AS dim_data_vintage
  FROM facts_v a JOIN facts_v b ON {on} AND a.pos < b.pos AND a.fact_id <> b.fact_id WHERE a.ekey <> '' AND a.mkey <> '' AND {UNITS_AGREE}), compared_v AS (
  SELECT *, list_filter([c_met, c_uni, c_tim, c_sco, c_geo, c_epi, c_vin], lambda c: c IS NOT NULL) AS codes,
    CASE WHEN 'UNIT_MISMATCH' = c_uni OR 'TIME_MISMATCH' = c_tim OR 'SCOPE_MISMATCH' = c_sco OR 'GEOGRAPHY_MISMATCH' = c_geo OR c_met IS NOT NULL THEN 'NON_COMPARABLE'
      WHEN coalesce(c_uni, c_tim, c_sco, c_geo) IS NOT NULL THEN 'INSUFFICIENT_CONTEXT' ELSE 'COMPARABLE' END AS status FROM coded)"""


SURFACED = f""", surfaced AS (
  SELECT *, CASE WHEN status = 'COMPARABLE' THEN 'MEANINGFUL_COMPARISON' WHEN status = 'NON_COMPARABLE' AND c_met IS NOT NULL THEN 'METRIC_MISMATCH_SUPPRESSED'
    WHEN status = 'NON_COMPARABLE' AND c_tim = 'TIME_MISMATCH' THEN CASE WHEN {temporal('fa.supporting_text', 'fb.supporting_text')} THEN 'EXPLICIT_TEMPORAL_COMPARISON' ELSE 'DIFFERENT_TIME_PERIOD_NO_LINK' END
    WHEN status = 'NON_COMPARABLE' THEN 'NON_COMPARABLE_NOT_MEANINGFUL' ELSE 'INSUFFICIENT_CONTEXT_MEANINGFUL' END AS surface_code FROM compared_v), shown AS (
  SELECT * FROM surfaced WHERE surface_code IN ('MEANINGFUL_COMPARISON', 'EXPLICIT_TEMPORAL_COMPARISON', 'INSUFFICIENT_CONTEXT_MEANINGFUL'))"""


def classified(source: str = "shown") -> str:
    ctx = lambda p: f"lower(coalesce({p}.data_vintage, '') || ' ' || {p}.supporting_text)"
    steps = " OR ".join(f"(fa.vk = {q(x)} AND fb.vk = {q(y)}) OR (fb.vk = {q(x)} AND fa.vk = {q(y)})" for x, y in V.VINTAGE_STEPS)
    differ = "(fa.vk <> '' AND fb.vk <> '' AND fa.vk <> fb.vk)"
    money = lambda x: f"format('{{:,.2f}}', {x})"
    newer = f"CASE WHEN {any_of(ctx('fb'), V.SUPERSESSION)} THEN 'Fact B' ELSE 'Fact A' END"
    older = f"CASE WHEN {any_of(ctx('fb'), V.SUPERSESSION)} THEN 'Fact A' ELSE 'Fact B' END"
    unit = "coalesce(fa.canonical_unit, '')"
    planned, observed = "('target', 'projected')", "('reported', 'audited')"
    return f""", stepped AS (
  SELECT *, CASE WHEN status = 'NON_COMPARABLE' THEN 'gate' WHEN status = 'INSUFFICIENT_CONTEXT' THEN 'context'
    WHEN (fa.epistemic_status IN {planned} AND fb.epistemic_status IN {observed}) OR (fb.epistemic_status IN {planned} AND fa.epistemic_status IN {observed}) THEN 'epistemic'
    WHEN {any_of(ctx('fa'), V.SUPERSESSION)} OR {any_of(ctx('fb'), V.SUPERSESSION)} THEN 'supersedes' WHEN {differ} AND ({steps}) THEN 'evolves' WHEN {differ} THEN 'vintage'
    WHEN fa.numeric_value IS NULL OR fb.numeric_value IS NULL THEN 'non_numeric' WHEN fa.numeric_value = fb.numeric_value THEN 'equal'
    WHEN abs(fa.numeric_value - fb.numeric_value) <= greatest(fa.resolution, fb.resolution) * 0.5 THEN 'rounding' ELSE 'conflict' END AS step FROM {source}), typed AS (
  SELECT *, CASE step WHEN 'supersedes' THEN 'SUPERSEDES' WHEN 'evolves' THEN 'EVOLVES_FROM' WHEN 'equal' THEN 'CORROBORATES' WHEN 'rounding' THEN 'CONTEXT_RESOLVES' WHEN 'conflict' THEN 'CONTRADICTS' ELSE 'UNRESOLVED' END AS relationship_type,
    CASE step WHEN 'gate' THEN 0.0 WHEN 'context' THEN 0.0 WHEN 'epistemic' THEN 0.9 WHEN 'vintage' THEN 0.8 WHEN 'non_numeric' THEN 0.5 WHEN 'equal' THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence,
    CASE step WHEN 'gate' THEN array_to_string(list_concat(['NON_COMPARABLE_CLAIMS'], codes), '|') WHEN 'context' THEN array_to_string(list_concat(['INSUFFICIENT_CONTEXT'], codes), '|')
      WHEN 'epistemic' THEN 'EPISTEMIC_STATUS_INCOMPATIBLE|EPISTEMIC_STATUS_DIFFERENCE' WHEN 'supersedes' THEN 'EXPLICIT_SUPERSEDED_CLAIM' WHEN 'evolves' THEN 'DATA_VINTAGE_EVOLUTION|LATER_DATA_VINTAGE'
      WHEN 'vintage' THEN 'UNRESOLVED_VINTAGE_RELATIONSHIP|DATA_VINTAGE_DIFFERENCE' WHEN 'non_numeric' THEN 'NON_NUMERIC_COMPARISON' WHEN 'equal' THEN 'EQUAL_NORMALIZED_VALUE'
      WHEN 'rounding' THEN 'ROUNDING_DIFFERENCE|CONTEXTUAL_RESOLUTION' ELSE 'VALUE_CONFLICT' END AS reason_codes,
    CASE step WHEN 'epistemic' THEN 'epistemic_status' WHEN 'supersedes' THEN 'supersession_evidence' WHEN 'evolves' THEN 'data_vintage' WHEN 'vintage' THEN 'data_vintage' WHEN 'non_numeric' THEN ''
      WHEN 'equal' THEN 'normalized_value' WHEN 'rounding' THEN 'display_rounding|scale_resolution' WHEN 'conflict' THEN 'value_conflict' ELSE {q('|'.join(V.DIMENSIONS))} END AS contextual_factors,
    CASE step WHEN 'gate' THEN 'Claims cannot be compared because the Comparability Gate identified incompatibility (' || array_to_string(codes, ', ') || '). Fact A: ''' || fa.metric || ''' (' || fa.period_label || '), Fact B: ''' || fb.metric || ''' (' || fb.period_label || ').'
      WHEN 'context' THEN 'Relationship cannot be safely established due to missing context (' || array_to_string(codes, ', ') || ').'
      WHEN 'epistemic' THEN 'Fact A (' || fa.epistemic_status || ') and Fact B (' || fb.epistemic_status || ') represent distinct epistemic categories (target/projection vs observed actuals) and are not contradictory.'
      WHEN 'supersedes' THEN {newer} || ' explicitly supersedes/restates the earlier claim in ' || {older} || ' based on official revision evidence.'
      WHEN 'evolves' THEN 'Fact B (''' || fb.data_vintage || ''') represents a subsequent data vintage revision of the claim in Fact A (''' || fa.data_vintage || ''') for ' || fa.canonical_metric || ' in ' || fa.period_label || '.'
      WHEN 'vintage' THEN 'Facts have different data vintages (''' || fa.data_vintage || ''' vs ''' || fb.data_vintage || '''), but sequential revision relationship is not explicitly established.'
      WHEN 'non_numeric' THEN 'One or both facts lack normalized numerical values for mathematical comparison.'
      WHEN 'equal' THEN 'Both sources independently corroborate the identical canonical value of ' || {money('fa.numeric_value')} || ' ' || {unit} || ' for ' || fa.canonical_entity || ' ''' || fa.canonical_metric || ''' in ' || fa.period_label || '.'
      WHEN 'rounding' THEN 'The claims (' || fa.value_raw || ' vs ' || fb.value_raw || ') appear different at surface level, but are mathematically consistent with display rounding within the implied ' || format('{{:,.0f}}', greatest(fa.resolution, fb.resolution)::DOUBLE) || ' ' || {unit} || ' resolution.'
      ELSE 'Both sources report materially conflicting values for ' || fa.canonical_entity || ' ''' || fa.canonical_metric || ''' in ' || fa.period_label || ' (' || fa.value_raw || ' [' || {money('fa.numeric_value')} || ' ' || {unit} || '] vs ' || fb.value_raw || ' [' || {money('fb.numeric_value')} || ' ' || {unit} || ']) exceeding display rounding precision without contextual justification.' END AS explanation FROM stepped), related AS (
  SELECT *, 'rel-' || substr(sha256(a_fact_id || '|' || b_fact_id || '|' || relationship_type), 1, 16) AS relationship_id FROM typed)"""


RELATED = compared() + SURFACED + classified()


def candidates() -> str:
    words = "list_filter(regexp_extract_all(mkey, '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN (" + _list(V.METRIC_STOPWORDS) + "))"
    one = "CASE WHEN ends_with(t, 'ies') AND length(t) > 4 THEN left(t, -3) || 'y' WHEN ends_with(t, 'es') AND length(t) > 4 AND substr(t, -3, 1) IN ('s','x','y','z','c','h') THEN left(t, -2) WHEN ends_with(t, 's') AND NOT ends_with(t, 'ss') AND length(t) > 3 THEN left(t, -1) ELSE t END"
    core = lambda x: f"list_filter({x}, lambda t: t NOT IN ({_list(V.QUANTITY_WORDS)}))"
    return f"""{facts()}, toks AS (SELECT *, list_distinct(list_transform({words}, lambda t: {one})) AS tk FROM facts_v), cores AS (SELECT *, {core('tk')} AS co FROM toks), cand_0 AS (
  SELECT a.pos AS a_pos, b.pos AS b_pos, a.fact_id AS a_fact_id, b.fact_id AS b_fact_id, a.ekey AS a_ekey, a.period_label AS a_label, b.period_label AS b_label, a.mkey = b.mkey AS same,
    len(a.tk) AS na, len(b.tk) AS nb, list_sort(list_intersect(a.tk, b.tk)) AS cm, len(list_distinct(list_concat(a.tk, b.tk))) AS nu, len(a.co) AS ca, len(b.co) AS cb, list_sort(a.co) AS core_a, list_sort(list_intersect(a.co, b.co)) AS cc
  FROM cores a JOIN cores b ON a.ekey = b.ekey AND a.pos < b.pos AND a.fact_id <> b.fact_id WHERE a.ekey <> '' AND a.mkey <> '' AND b.mkey <> '' AND {UNITS_AGREE}), cand AS (
  SELECT *, CASE WHEN same THEN 'exact' WHEN na = 0 OR nb = 0 THEN NULL WHEN len(cm) = na AND len(cm) = nb THEN 'tokens' WHEN len(cm) = na OR len(cm) = nb THEN 'subset'
    WHEN ca > 0 AND cb > 0 AND len(cc) = ca AND len(cc) = cb THEN 'core' WHEN ca > 0 AND cb > 0 AND (len(cc) = ca OR len(cc) = cb) THEN 'core_subset' WHEN 2 * len(cm) >= nu THEN 'overlap' END AS kind FROM cand_0), cand_v AS (
  SELECT *, CASE kind WHEN 'exact' THEN 1.0 WHEN 'tokens' THEN 0.95 WHEN 'subset' THEN 0.85 WHEN 'core' THEN 0.8 WHEN 'core_subset' THEN 0.75 ELSE round_even(0.5 + 0.5 * len(cm) / nu, 2) END::DOUBLE AS candidate_score,
    'ENTITY_MATCH|' || CASE kind WHEN 'exact' THEN 'EXACT_METRIC_MATCH' WHEN 'tokens' THEN 'CANONICAL_METRIC_TOKEN_MATCH' WHEN 'subset' THEN 'METRIC_SUBSET_MATCH: ' || array_to_string(cm, ', ')
      WHEN 'core' THEN 'METRIC_CORE_NOUN_MATCH: ' || array_to_string(core_a, ', ') WHEN 'core_subset' THEN 'METRIC_CORE_SUBSET_MATCH: ' || array_to_string(cc, ', ')
      ELSE 'HIGH_PRECISION_METRIC_OVERLAP (Jaccard ' || format('{{:.2f}}', len(cm) / nu) || '): ' || array_to_string(cm, ', ') END AS reasons FROM cand WHERE kind IS NOT NULL)"""


SNIPPETS = PAGES + """, snip AS (
  SELECT doc_id AS pos, document_id, (page_number + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END)::INT AS page_number, CASE WHEN doc_id % 21 = 0 THEN '' ELSE 'E' END AS entity, 'm' AS metric, '1' AS value_raw,
    'P' || doc_id % 4 AS period_label, '  ' || substr(text, 11, 40) || CASE WHEN doc_id % 6 = 0 THEN '' ELSE ' §' END || chr(10) AS supporting_text, 'f' || doc_id % 50 AS fact_id
  FROM pages_v WHERE has_text), ground AS (
  SELECT s.*, t <> '' AND contains(coalesce(p.text, ''), t) AS is_exact, t <> '' AND (contains(coalesce(p.text, ''), t) OR contains({cp}, {ct})) AS is_grounded
  FROM (SELECT *, {st} AS t FROM snip) s LEFT JOIN pages_v p USING (document_id, page_number))""".replace("{cp}", collapse("coalesce(p.text, '')")).replace("{ct}", collapse("t")).replace("{st}", strip("supporting_text"))

REQUESTS = """req AS (SELECT event_id AS request_id, (user_id % 7)::INT AS batch_id, (event_id % 3)::INT AS run_id, epoch_ms(ts) AS start_ms, epoch_ms(ts) + round(value * 10)::BIGINT AS end_ms, event_type AS outcome, round(value * 10)::BIGINT AS latency_ms FROM events)"""

PROMPTS = f""", batches AS (
  SELECT p.document_id, p.batch_id, count(*)::INT AS n_pages, 'Document: ' || p.document_id || chr(10) || 'Document Date: Unknown' || chr(10) || 'Pages in this batch: ' || string_agg(p.page_number::VARCHAR, ', ' ORDER BY p.page_number)
    || chr(10) || chr(10) || 'Extract all facts and assign each fact strictly to its source page_number.' || chr(10) || chr(10)
    || string_agg('===== DOCUMENT PAGE ' || p.page_number || ' START =====' || chr(10) || {strip("coalesce(c.prompt_text, '')")} || chr(10) || '===== DOCUMENT PAGE ' || p.page_number || ' END =====' || chr(10), chr(10) ORDER BY p.page_number) AS prompt
  FROM plan_v p JOIN prompts c USING (document_id, page_number) WHERE p.planned GROUP BY p.document_id, p.batch_id)"""


def _with_scores(context: str) -> str:
    """The context's CTEs and those of the scores, of which some are shared."""
    return context + SCORES.removeprefix(LINES)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    w = lambda ctes, select: f"WITH {ctes}\n{select}"
    out["doc_identity"] = "SELECT doc_id, substr(sha256(text), 1, 16) AS document_id, length(text)::INT AS char_count, trim(text) <> '' AS has_text FROM documents"
    out["newline_clean"] = "SELECT page_id, length(t)::INT AS n_chars, sha256(t) AS digest FROM (SELECT page_id, regexp_replace(url || chr(13) || chr(10) || html || chr(13), '\\r\\n?', chr(10), 'g') AS t FROM pages)"
    out["page_signals"] = w(SCORES, f"SELECT document_id, page_number, len(nums)::INT AS n_numbers, {bar('nums[1:10]')} AS sample_numbers, table_rows, {bar('currencies')} AS currencies, {bar('units')} AS units, {bar('metrics')} AS metrics, {bar('temporals')} AS temporals, {bar('boilerplates')} AS boilerplates FROM sig")
    names = ("numeric_density", "currency", "unit", "metric", "table_structure", "temporal", "neighbor_context", "boilerplate_penalty")
    parts = ", ".join(f"CASE WHEN p{i + 1} <> 0 AND has_text THEN '{n}=' || p{i + 1} END" for i, n in enumerate(names))
    out["page_relevance"] = w(SCORES, f"SELECT document_id, page_number, h / 100 AS score, h >= 35 AND has_text AS selected, {bar(f'list_sort(list_filter([{parts}], lambda x: x IS NOT NULL))', ',')} AS breakdown FROM scored")
    fst = lambda c, k: f"array_to_string({c}[1:{k}], ',')"
    trig = [
        "CASE WHEN len(nums) > 0 THEN 'numeric_density(' || len(nums) || ')' END",
        f"CASE WHEN len(currencies) > 0 THEN 'currency_indicator(' || {fst('currencies', 3)} || ')' END",
        f"CASE WHEN len(units) > 0 THEN 'quantitative_unit(' || {fst('units', 3)} || ')' END",
        f"CASE WHEN len(metrics) > 0 THEN 'metric_keyword(' || {fst('metrics', 3)} || ')' END",
        "CASE WHEN table_rows > 0 THEN 'tabular_structure(' || table_rows || '_rows)' END",
        f"CASE WHEN len(temporals) > 0 THEN 'temporal_marker(' || {fst('temporals', 2)} || ')' END",
        "CASE WHEN p7 > 0 THEN 'neighbor_metric_context' END",
        f"CASE WHEN p8 < 0 THEN 'boilerplate_penalty(' || {fst('boilerplates', 2)} || ')' END",
    ]
    told = f"SELECT *, list_filter([{', '.join(trig)}], lambda x: x IS NOT NULL AND has_text) AS ts FROM scored"
    out["page_explanations"] = w(SCORES, f"SELECT document_id, page_number, {bar('ts')} AS signals, CASE WHEN NOT has_text THEN 'Page contains no extractable text content.' ELSE 'Score: ' || format('{{:.3f}}', h / 100) || ' (Threshold: 0.35); ' || CASE WHEN len(ts) > 0 THEN 'Signals: ' || array_to_string(ts, ', ') ELSE 'No quantitative signals identified.' END END AS explanation FROM ({told})")
    out["page_selected"] = w(SCORES, "SELECT document_id, page_number, h / 100 AS score FROM scored WHERE has_text AND h >= 30")
    out["eligible_pages"] = w(SCORES, "SELECT document_id, page_number FROM scored WHERE has_text AND h >= 30")
    out["page_limits"] = w(PAGES, "SELECT document_id, page_number, 'first' AS kind FROM pages_v WHERE page_number <= 3 UNION ALL SELECT document_id, page_number, 'given' FROM pages_v WHERE page_number IN (2, 5, 7)")
    html = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)</(?:p|div|h[1-6]|li|tr|title)>|<br/?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"
    out["layout_blocks"] = f"""WITH b AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(regexp_replace({html}, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n\\s*'), lambda x: {strip('x')} <> '')) AS c FROM pages)
SELECT page_id, count(*) FILTER (NOT contains(trim(c), chr(10)) AND length(trim(c)) < 60) AS n_headings, count(*) FILTER (contains(trim(c), chr(10)) OR length(trim(c)) >= 60) AS n_paragraphs FROM b GROUP BY 1"""
    n = lambda x, p: f"len({every(x, p)})"
    t = plain("text")
    wide = f"{n('x', V.PLAIN_NUMBER)} >= 3 OR (contains(x, chr(9)) AND {n('x', V.PLAIN_NUMBER)} >= 2)"
    out["page_complexity"] = w(PAGES, f"SELECT document_id, page_number, {n(t, V.PLAIN_NUMBER)}::INT AS n_numbers, {n(t, '(?i)' + V.PLAIN_PERCENT)}::INT AS n_percents, {n(t, '(?i)' + V.PLAIN_CURRENCY)}::INT AS n_currencies, len(list_filter(string_split({t}, chr(10)), lambda x: {wide}))::INT AS n_table_lines FROM pages_v")

    out["line_regions"] = w(REGIONS, f"SELECT document_id, page_number, line_no, anchor_text, {bar('signals')} AS signals, length(line)::INT AS n_chars FROM regions")
    nl = "chr(10)"
    out["context_windows"] = w(WINDOWS, f"SELECT document_id, page_number, start_line, end_line, array_to_string(anchors, {nl}) AS anchors, {bar('signals')} AS signals, length(source_text)::INT AS char_count, sha256(source_text) AS digest FROM wtext")
    out["page_context"] = w(CONTEXT, f"SELECT document_id, page_number, original_chars, selected_chars, CASE WHEN original_chars > 0 THEN {round_even('selected_chars / original_chars', 4)} ELSE 0 END::DOUBLE AS compression_ratio, n_windows, signals, length(combined_text)::INT AS combined_chars, n_windows = 0 AS is_empty FROM ctx")
    sweep = REGIONS + ", radii AS (SELECT unnest([1, 2, 3, 5])::INT AS radius), widened AS (SELECT * FROM regions, radii)" + windows("radius", "widened", ", radius")
    sweep += """, per AS (SELECT p.document_id, p.page_number, r.radius, length(p.text) AS whole, count(w.island)::INT AS n, coalesce(sum(length(array_to_string(a.lines[w.start_line + 1:w.end_line + 1], chr(10)))), 0) AS sel
  FROM pages_v p CROSS JOIN radii r JOIN arr a USING (document_id, page_number) LEFT JOIN wins w ON w.document_id = p.document_id AND w.page_number = p.page_number AND w.radius = r.radius WHERE p.has_text GROUP BY ALL)"""
    out["radius_sweep"] = w(sweep, f"SELECT radius, count(*) AS n_pages, sum(whole)::BIGINT AS original_chars, sum(sel)::BIGINT AS selected_chars, {round_even('100 * (1 - sum(sel) / sum(whole))', 2)} AS reduction_pct, sum(n)::BIGINT AS n_windows, max(n) AS max_windows, quantile_cont(n, 0.5)::DOUBLE AS median_windows FROM per GROUP BY radius")
    gold = "SELECT document_id, page_number, contains(lower(combined_text), regexp_extract(text, '(\\d{2,})', 1)) AS kept_value, contains(lower(combined_text), lower(substr(text, 1, 12))) OR contains(lower(combined_text), 'no such text') AS kept_metric, true AS kept_unit FROM ctx"
    out["gold_coverage"] = w(CONTEXT, f"SELECT *, kept_value AND kept_metric AS recalled FROM ({gold})")

    planned = SCORES + plan()
    out["quota_plan"] = w(planned, "SELECT document_id, page_number, n_eligible, planned, batch_id FROM plan_v")
    out["quota_summary"] = w(planned, "SELECT document_id, max(n_eligible) AS n_eligible, sum(planned::INT)::BIGINT AS n_planned, (max(n_eligible) - sum(planned::INT))::BIGINT AS n_deferred, ceil(max(n_eligible) / 5)::BIGINT AS estimated_requests, ceil(sum(planned::INT) / 5)::BIGINT AS planned_requests, ceil(max(n_eligible) / 5) <= 3 AS can_complete, (3 - ceil(sum(planned::INT) / 5))::BIGINT AS remaining_budget FROM plan_v GROUP BY 1")
    both = _with_scores(CONTEXT) + plan()
    out["batch_prompt"] = w(both + PROMPTS, "SELECT document_id, batch_id, n_pages, length(prompt)::INT AS n_chars, sha256(prompt) AS digest FROM batches")
    out["input_fingerprint"] = w(both + PROMPTS, f"SELECT document_id, batch_id, sha256(k) AS fingerprint, substr(sha256(k), 1, 16) AS short_fingerprint FROM (SELECT *, document_id || {nl} || batch_id || {nl} || prompt AS k FROM batches)")
    out["batch_payload"] = w(both, f"""SELECT document_id, batch_id, count(*) AS n_pages, sum(n_windows)::INT AS n_windows, CASE WHEN sum(n_windows) > 0 THEN {round_even('sum(selected_chars) / sum(n_windows)', 1)} ELSE 0 END::DOUBLE AS avg_window, coalesce(max(list_max(sizes)), 0)::INT AS max_window,
  sum(length(text))::BIGINT AS raw_chars, sum(length(prompt_text))::BIGINT AS compressed_chars, {round_even('sum(length(prompt_text)) / sum(length(text))', 3)} AS compression_ratio FROM plan_v JOIN prompts USING (document_id, page_number) WHERE planned GROUP BY 1, 2""")
    out["batch_sweep"] = w(CONTEXT, f"""SELECT batch_size, total_pages, requests, raw_chars, selected_chars, {round_even('100 * (1 - requests / total_pages)', 2)} AS request_reduction_pct, {round_even('100 * (1 - selected_chars / raw_chars)', 2)} AS char_reduction_pct FROM (
  SELECT batch_size, sum(n)::BIGINT AS total_pages, sum(ceil(n / batch_size))::BIGINT AS requests, sum(raw)::BIGINT AS raw_chars, sum(sel)::BIGINT AS selected_chars FROM (SELECT document_id, count(*) AS n, sum(original_chars) AS raw, sum(selected_chars) AS sel FROM ctx GROUP BY 1), (SELECT unnest([1, 2, 3, 5])::INT AS batch_size) GROUP BY 1)""")
    out["budget_simulation"] = w(SCORES, f"""SELECT budget, batch_size, ceil(n / batch_size)::BIGINT AS requests_needed, least(n, budget * batch_size) AS processable_pages, n - least(n, budget * batch_size) AS deferred_pages, {round_even('100 * least(n, budget * batch_size) / n', 1)} AS coverage_pct,
  CASE WHEN least(n, budget * batch_size) = n THEN 'COMPLETE' ELSE 'PARTIAL_QUOTA' END AS status FROM (SELECT count(*) AS n FROM scored WHERE has_text AND h >= 30), (SELECT unnest([10, 20, 50, 100])::INT AS budget), (SELECT unnest([1, 2, 3, 5])::INT AS batch_size)""")
    out["size_projection"] = f"SELECT document_id, total_pages, batch_size, e AS eligible_pages, r AS requests, {round_even('100 * (1 - r / total_pages)', 1)} AS reduction_pct, e - r AS saved_requests FROM (SELECT *, floor(total_pages * 60 / 100)::BIGINT AS e, ceil(floor(total_pages * 60 / 100) / batch_size)::BIGINT AS r FROM (SELECT source AS document_id, count(*) AS total_pages FROM documents GROUP BY 1), (SELECT unnest([1, 2, 3, 5])::INT AS batch_size))"
    out["latency_projection"] = w(REQUESTS, "SELECT batch_size, pages, ceil(pages / batch_size)::BIGINT AS requests, (ceil(pages / batch_size) * m)::BIGINT AS projected_ms FROM (SELECT batch_id AS batch_size, floor(avg(latency_ms))::BIGINT AS m FROM req WHERE batch_id > 0 GROUP BY 1), (SELECT unnest([50, 100, 184, 300, 500])::INT AS pages)")

    low = "lower(line)"
    rx = lambda p, g=0: every("line", "(?i)" + p, g)
    firsts = f"list_concat(list_concat(list_filter(list_transform({rx(V.RULE_MONEY)}, lambda x: {strip('x')}), lambda x: length(x) > 1), list_transform({rx(V.RULE_PERCENT)}, lambda x: {strip('x')})), list_filter(list_transform(range(1, len({rx(V.RULE_BOUND)}) + 1), lambda i: {strip(f'({rx(V.RULE_BOUND, 1)})[i] || ({rx(V.RULE_BOUND, 2)})[i]')}), lambda x: length(x) > 1))"
    # An exact count is new unless an earlier value, of whichever kind, holds it.
    rules = LINES + f""", seg AS (SELECT *, {plain('ln')} AS line, row_number() OVER () AS rid FROM (SELECT document_id, page_number, {strip('raw')} AS ln FROM lines_v) WHERE length(ln) > 3), vals AS (
  SELECT *, {firsts} AS fs, list_transform({rx(V.RULE_COUNT, 1)}, lambda x: {strip('x')}) AS cs FROM seg), alone AS (
  SELECT *, list_filter(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN len(list_filter(list_concat(fs, cs[1:i-1]), lambda v: contains(v, cs[i]))) = 0 THEN cs[i] END), lambda x: x IS NOT NULL) AS es FROM vals), ex AS (
  SELECT *, unnest(list_concat(list_distinct(fs), es)) AS value_raw FROM alone), read AS (
  SELECT *, {ladder(low, V.RULE_ENTITIES, V.NO_ENTITY)} AS entity, {ladder(low, V.RULE_METRICS, V.NO_METRIC)} AS metric,
    CASE WHEN {any_of('value_raw', ('₹', 'INR', 'Rs'))} OR {any_of('lower(value_raw)', ('million', 'cr'))} THEN 'INR' WHEN contains(value_raw, '%') THEN 'percent' WHEN contains(lower(value_raw), 'tonnes') THEN 'tonnes'
      WHEN contains(lower(value_raw), 'shipments') THEN 'shipments' WHEN contains(lower(value_raw), 'customers') THEN 'customers' WHEN contains(lower(value_raw), 'pin') THEN 'pin codes' END AS unit,
    coalesce(nullif(regexp_extract(line, {q('(?i)' + V.RULE_FISCAL)}, 1), ''), nullif(regexp_extract(line, {q(V.RULE_CALENDAR)}, 1), ''), {q(V.NO_PERIOD)}) AS period_label,
    {ladder(f"lower({ladder(low, V.RULE_STATUS, 'Reported Fact')})", V.STATUS_WORDS, 'reported')} AS epistemic_status FROM ex)"""
    fid = FACT_ID.format(d="document_id", p="page_number", e="entity", m="metric", v="value_raw", l="period_label")
    out["rule_extract"] = w(rules, f"SELECT document_id, page_number, value_raw, entity, metric, {numeric_candidate('value_raw')} AS value_numeric, unit, period_label, epistemic_status, length(ln)::INT AS n_chars, {fid} AS fact_id FROM read")
    out["numeric_candidate"] = w(claims(), f"SELECT pos, {numeric_candidate('value_raw')} AS number FROM claims_v")
    lab = ladder("lower(t)", V.RULE_STATUS, "Reported Fact")
    out["epistemic_detect"] = w(claims(), f"SELECT pos, {lab} AS label, {ladder(f'lower({lab})', V.STATUS_WORDS, 'reported')} AS status FROM (SELECT pos, concat_ws(' ', supporting_text, data_vintage, epistemic_status) AS t FROM claims_v)")
    out["fact_id"] = w(claims(), "SELECT pos, fact_id FROM claims_v")
    out["grounding"] = w(SNIPPETS, "SELECT pos, is_grounded, is_exact FROM ground")
    all_batches = ", bat AS (SELECT document_id, page_number, (row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1) // 5 AS batch_id FROM pages_v WHERE has_text)"
    out["contamination"] = w(SNIPPETS + all_batches, f"""SELECT pos, is_grounded, NOT is_grounded AND EXISTS (SELECT 1 FROM bat b JOIN bat o ON o.document_id = b.document_id AND o.batch_id = b.batch_id AND o.page_number <> b.page_number JOIN pages_v p ON p.document_id = o.document_id AND p.page_number = o.page_number
  WHERE b.document_id = g.document_id AND b.page_number = g.page_number AND (contains(p.text, g.t) OR contains({collapse('p.text')}, {collapse('g.t')}))) AS is_contaminated FROM (SELECT *, {strip('supporting_text')} AS t FROM ground) g""")
    out["duplicate_reject"] = w(SNIPPETS, "SELECT pos, fact_id, row_number() OVER (PARTITION BY fact_id ORDER BY pos) > 1 AS is_duplicate FROM snip")
    out["reject_reasons"] = w(SNIPPETS, "SELECT CASE WHEN NOT g.page_number <= 20 OR p.page_number IS NULL THEN 'page_outside_batch' WHEN entity = '' THEN 'missing_field' WHEN NOT is_grounded THEN 'not_grounded' ELSE 'accepted' END AS reason, count(*) AS n FROM ground g LEFT JOIN (SELECT document_id, page_number FROM pages_v WHERE has_text) p ON p.document_id = g.document_id AND p.page_number = g.page_number GROUP BY 1")
    out["read_candidates"] = w(claims(), f"SELECT pos, page_number, (pos % 97)::DOUBLE AS value_numeric, l AS period_label, CASE WHEN pos % 3 = 0 THEN 'reported' ELSE epistemic_status END AS epistemic_status, CASE WHEN pos % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS extraction_confidence, {FACT_ID.format(d='document_id', p='page_number', e='entity', m='metric', v='value_raw', l='l')} AS fact_id FROM (SELECT *, CASE WHEN pos % 5 <> 0 THEN period_label ELSE 'Unspecified' END AS l FROM claims_v)")
    out["lenient_candidates"] = w(claims(), f"SELECT pos, e AS entity, m AS metric, NULL::VARCHAR AS data_vintage, {FACT_ID.format(d='document_id', p='page_number', e='e', m='m', v='value_raw', l=q('Unspecified'))} AS fact_id FROM (SELECT *, CASE WHEN page_number % 4 > 0 THEN entity ELSE 'Unknown' END AS e, CASE WHEN page_number % 3 > 0 THEN metric ELSE 'Unknown' END AS m FROM claims_v)")
    out["evidence"] = w(claims(), "SELECT pos, document_id, period_label AS document_date, page_number, supporting_text FROM claims_v")
    number_ = "regexp_extract(document_id, '(\\d+)$', 1)::INT"
    outcome = SCORES + plan(6) + f""", outc AS (SELECT DISTINCT document_id, batch_id, CASE WHEN batch_id = {number_} % 7 AND {number_} % 3 = 0 THEN 'quota' WHEN batch_id = {number_} % 5 AND {number_} % 4 = 1 THEN 'error' ELSE 'ok' END AS outcome FROM plan_v WHERE planned), stops AS (
  SELECT document_id, min(batch_id) AS b, arg_min(outcome, batch_id) AS o FROM outc WHERE outcome <> 'ok' GROUP BY 1), stat_0 AS (
  SELECT document_id, max(n_eligible) AS n_eligible, count(*) FILTER (planned AND (b IS NULL OR batch_id < b)) AS n_processed, count(DISTINCT CASE WHEN planned AND (b IS NULL OR batch_id < b) THEN batch_id END) AS requests_used, max(o) AS o
  FROM plan_v LEFT JOIN stops USING (document_id) GROUP BY 1), stat AS (
  SELECT document_id, n_eligible, n_processed, n_eligible - n_processed AS n_unprocessed, requests_used, CASE WHEN o = 'quota' THEN CASE WHEN n_processed = 0 THEN 'QUOTA_EXHAUSTED' ELSE 'PARTIAL_QUOTA' END WHEN o IS NOT NULL THEN 'FAILED' WHEN n_eligible > n_processed THEN 'PARTIAL_QUOTA' ELSE 'COMPLETE' END AS status FROM stat_0)"""
    out["extraction_status"] = w(outcome, "SELECT * FROM stat")
    out["status_rollup"] = w(outcome, "SELECT count(*) AS n_documents, sum(n_eligible)::BIGINT AS n_eligible, sum(n_processed)::BIGINT AS n_processed, sum(n_unprocessed)::BIGINT AS n_unprocessed, sum(requests_used)::BIGINT AS requests_used, CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' ELSE coalesce(arg_max(status, document_id) FILTER (status <> 'COMPLETE'), 'COMPLETE') END AS status FROM stat")
    out["unprocessed_pages"] = w(planned, "SELECT document_id, page_number FROM plan_v WHERE NOT planned")

    from .registry import EDGE_PERIODS, EDGE_VALUES  # the cases of the queries

    lit = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else repr(x)
    cases = "edge AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lit(v)}, {lit(u)}::VARCHAR, {lit(n_)}::DOUBLE)" for i, (v, u, n_) in enumerate(EDGE_VALUES)) + ") AS e(case_id, value_raw, unit, value_numeric))"
    out["value_normalize"] = w(claims() + ", " + cases + ", told AS (SELECT pos AS case_id, value_raw, unit, value_numeric FROM claims_v UNION ALL SELECT (-1 - case_id)::BIGINT, value_raw, unit, value_numeric FROM edge), " + values("told"), "SELECT case_id, numeric_value, canonical_unit, scale, value_qualifier, currency, status, note FROM val_v")
    out["value_qualifier"] = w(claims() + ", " + cases, f"SELECT pos, {qualifier('value_raw')} AS value_qualifier FROM claims_v UNION ALL SELECT (-1 - case_id)::BIGINT, {qualifier('value_raw')} FROM edge")
    out["semantic_unit"] = f"SELECT doc_id, {semantic('text')} AS semantic_unit FROM documents"
    labels = "edge AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {lit(p)}, {lit(c)}::VARCHAR)" for i, (p, c) in enumerate(EDGE_PERIODS)) + ") AS e(case_id, period_label, calendar))"
    out["period_normalize"] = w(claims() + ", " + labels + ", told AS (SELECT pos AS case_id, period_label, CASE WHEN pos % 2 = 0 THEN 'april-march' END AS calendar FROM claims_v UNION ALL SELECT (-1 - case_id)::BIGINT, period_label, calendar FROM edge), " + periods("told", "calendar"), 'SELECT case_id, norm_start AS "start", norm_end AS "end", warning FROM per_v')
    suffixes = [" Limited", ", Inc.", " Pvt. Ltd", "  S.A.", " plc.", " Holdings,", " GmbH"]
    named = f"' ' || s_name || ([{_list(suffixes)}])[(s_suppkey % 7 + 1)::INT]"
    out["entity_normalize"] = f"SELECT s_suppkey, {entity(named)} AS entity FROM supplier"
    out["metric_normalize"] = f"SELECT p_partkey, {metric(chr(39) + ' ' + chr(39) + ' || replace(p_name, ' + q(' ') + ', chr(9) || ' + q(' ') + ') || ' + q(' Count '))} AS metric FROM part"
    out["normalized_facts"] = w(facts(), "SELECT pos, canonical_entity, canonical_metric, numeric_value, canonical_unit, scale, value_qualifier, currency, status AS normalization_status, norm_start, norm_end, concat_ws('|', note, CASE WHEN norm_start IS NULL THEN warning END) AS warnings FROM facts_v")

    out["candidate_pairs"] = w(candidates(), "SELECT a_ekey, candidate_score, count(*) AS n FROM cand_v GROUP BY 1, 2")
    out["candidate_scores"] = w(candidates(), "SELECT a_pos, b_pos, candidate_score, reasons FROM cand_v")
    out["unit_veto"] = w(facts(), f"SELECT a.canonical_unit AS unit_a, b.canonical_unit AS unit_b, {UNITS_AGREE} AS agree, count(*) AS n FROM facts_v a JOIN facts_v b ON a.ekey = b.ekey AND a.pos < b.pos GROUP BY 1, 2, 3")
    near = candidates() + compared("nation", "a.ekey = b.ekey").removeprefix(facts()) + ", near AS (SELECT c.* FROM compared_v c JOIN cand_v USING (a_pos, b_pos))"
    near_surfaced = near + SURFACED.replace("FROM compared_v)", "FROM near)")
    out["comparability"] = w(near, f"SELECT a_pos, b_pos, status, {bar('codes')} AS codes, dim_unit, dim_time_period, dim_scope, dim_geography, dim_epistemic_status, dim_data_vintage FROM near")
    out["comparability_reasons"] = w(near, "SELECT status, code, count(*) AS n FROM (SELECT status, unnest(codes) AS code FROM near) GROUP BY 1, 2")
    out["surfaced_pairs"] = w(near_surfaced, "SELECT a_pos, b_pos, surface_code, surface_code IN ('MEANINGFUL_COMPARISON', 'EXPLICIT_TEMPORAL_COMPARISON', 'INSUFFICIENT_CONTEXT_MEANINGFUL') AS should_surface FROM surfaced")
    why = {
        "METRIC_MISMATCH_SUPPRESSED": "Claims represent different metrics/measurements.",
        "MEANINGFUL_COMPARISON": "Claims are comparable across all verified dimensions.",
        "EXPLICIT_TEMPORAL_COMPARISON": "Source evidence explicitly contains temporal comparison language connecting the periods.",
        "DIFFERENT_TIME_PERIOD_NO_LINK": "Claims describe different bounded time periods without explicit comparative language in source text.",
        "INSUFFICIENT_CONTEXT_MEANINGFUL": "Meaningful claim comparison with unresolved missing contextual dimensions.",
    }
    texts = "CASE surface_code " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in why.items()) + " ELSE 'Claims are fundamentally non-comparable (' || array_to_string(codes, ', ') || ').' END"
    out["surfacing_texts"] = w(near_surfaced, f"SELECT {texts} AS surface_explanation, surface_code || CASE surface_code WHEN 'DIFFERENT_TIME_PERIOD_NO_LINK' THEN '|NON_COMPARABLE_NOT_MEANINGFUL' WHEN 'METRIC_MISMATCH_SUPPRESSED' THEN '|NON_COMPARABLE_NOT_MEANINGFUL' WHEN 'NON_COMPARABLE_NOT_MEANINGFUL' THEN '|' || array_to_string(codes, '|') ELSE '' END AS reasons, count(*) AS n FROM surfaced GROUP BY 1, 2")
    pair = lambda k: f"'''' || fa.{k} || ''' vs ''' || fb.{k} || '''.'"
    note = f"""concat_ws(' ', CASE WHEN c_met IS NOT NULL THEN 'Different metrics: ' || {pair('mkey')} END, CASE c_uni WHEN 'MISSING_UNIT' THEN 'Unit/currency could not be safely resolved on one or both facts.' WHEN 'UNIT_MISMATCH' THEN 'Incompatible units: ' || {pair('canonical_unit')} END,
      CASE c_tim WHEN 'MISSING_TIME_PERIOD' THEN 'Time period interval not safely bounded on one or both facts.' WHEN 'TIME_MISMATCH' THEN 'Different measurement periods: [' || fa.norm_start || ' to ' || fa.norm_end || '] vs [' || fb.norm_start || ' to ' || fb.norm_end || '].' END,
      CASE c_sco WHEN 'SCOPE_MISMATCH' THEN 'Conflicting scopes: ' || {pair('sk')} WHEN 'MISSING_SCOPE' THEN 'Scope is specified on one claim but unspecified on the other.' END,
      CASE c_geo WHEN 'GEOGRAPHY_MISMATCH' THEN 'Conflicting geographies: ' || {pair('gk')} WHEN 'MISSING_GEOGRAPHY' THEN 'Geography is specified on one claim but unspecified on the other.' END,
      CASE WHEN c_epi IS NOT NULL THEN 'Epistemic status differs: ' || {pair('epistemic_status')} END, CASE WHEN c_vin IS NOT NULL THEN 'Data vintage differs: ' || {pair('vk')} END)"""
    out["comparability_notes"] = w(near, f"SELECT a_pos, b_pos, {note} AS notes FROM near")
    cut = "supporting_text || CASE pos_ % 3 WHEN 0 THEN ' rose' WHEN 1 THEN ' was 5 in 2001' ELSE '' END"
    out["temporal_language"] = w(claims(), f"""SELECT pos_ AS pos, case_id, {temporal('x', 'told')} AS linked FROM (SELECT pos AS pos_, supporting_text, {cut.replace('pos_', 'pos')} AS x FROM (SELECT pos, supporting_text FROM claims_v UNION ALL SELECT -1 - doc_id, text FROM documents)), (VALUES (0, 'From 3 to 5.'), (1, 'and 6 in 2002'), (2, 'plain')) AS told_v(case_id, told)""")
    out["relationships"] = w(RELATED, "SELECT relationship_id, a_fact_id, b_fact_id, relationship_type, confidence, reason_codes, contextual_factors, explanation FROM related")
    out["relationship_counts"] = w(RELATED, "SELECT relationship_type, confidence, count(*) AS n FROM related GROUP BY 1, 2")
    out["relationship_counts_by_customer"] = w(compared("customer") + SURFACED + classified(), "SELECT relationship_type, confidence, count(*) AS n FROM related GROUP BY 1, 2")
    out["relationship_ids"] = w(RELATED, "SELECT a_pos, b_pos, relationship_id FROM related")
    out["display_resolution"] = w(facts(), "SELECT pos, resolution::DOUBLE AS resolution FROM facts_v")
    pair_rows = candidates() + compared("nation", "a.ekey = b.ekey").removeprefix(facts()) + ", chosen AS (SELECT c.* FROM compared_v c JOIN cand_v USING (a_pos, b_pos))" + classified("chosen")
    out["pair_reason"] = w(pair_rows, "SELECT a_pos, b_pos, status, step, relationship_type, confidence FROM related")

    out["analysis_summary"] = w(RELATED, "SELECT (SELECT string_agg(DISTINCT document_id, ',' ORDER BY document_id) FROM claims_v) AS document_ids, (SELECT count(DISTINCT document_id) FROM claims_v) AS n_documents, (SELECT count(*) FROM claims_v) AS n_facts, (SELECT count(*) FROM related) AS n_relationships")
    out["facts_per_page"] = w(claims(), "SELECT page_number, count(*) AS n FROM claims_v GROUP BY 1")
    out["facts_per_document"] = w(claims() + ", " + PAGES, "SELECT d.document_id, count(c.pos) AS n FROM (SELECT DISTINCT document_id FROM pages_v UNION SELECT DISTINCT document_id FROM claims_v) d LEFT JOIN claims_v c USING (document_id) GROUP BY 1")
    rate = lambda a, b, e: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE {e} END::DOUBLE"
    out["quality_metrics"] = w(SNIPPETS, f"""SELECT n AS n_candidates, v AS n_verified, {rate('v', 'n', 1)} AS grounding_rate, {rate('x', 'v', 1)} AS attribution_rate, v - k AS n_duplicates, {rate('(v - k)', 'v', 0)} AS duplicate_rate, {rate('0', 'v', 1)} AS entity_rate, {rate('0', 'v', 1)} AS metric_rate, {rate('v', 'v', 1)} AS value_rate, {rate('v', 'v', 1)} AS period_rate
  FROM (SELECT count(*) AS n, count(*) FILTER (is_grounded) AS v, count(*) FILTER (is_grounded AND is_exact) AS x, count(DISTINCT CASE WHEN is_grounded THEN lower(entity) || '|' || lower(metric) || '|' || lower(period_label) END) AS k FROM ground)""")
    pct = lambda a, b: f"CASE WHEN {b} > 0 THEN {round_even(f'100 * {a} / {b}', 1)} ELSE 0 END::DOUBLE"
    out["threshold_sweep"] = w(SCORES, f"""SELECT *, {pct('tp', '(tp + fn)')} AS recall_pct, {pct('tp', '(tp + fp)')} AS precision_pct, {pct('(fn + tn)', '(tp + fp + fn + tn)')} AS reduction_pct FROM (
  SELECT threshold, count(*) FILTER (quality = 1 AND h >= threshold) AS tp, count(*) FILTER (quality <> 1 AND h >= threshold) AS fp, count(*) FILTER (quality = 1 AND h < threshold) AS fn, count(*) FILTER (quality <> 1 AND h < threshold) AS tn
  FROM scored JOIN labels USING (doc_id), (SELECT unnest([20, 30, 35, 40, 50, 60, 70])::INT AS threshold) GROUP BY 1)""")
    out["corpus_rollup"] = w(SCORES, f"SELECT document_id, count(*) AS n_pages, count(*) FILTER (has_text) AS n_text, count(*) FILTER (has_text AND h >= 35) AS n_selected, {pct('(count(*) FILTER (has_text) - count(*) FILTER (has_text AND h >= 35))', 'count(*) FILTER (has_text)')} AS reduction_pct FROM scored GROUP BY ROLLUP (document_id)")
    both_v = "f AS (SELECT DISTINCT document_id, page_number, value_raw FROM read), g AS (SELECT DISTINCT document_id, page_number, regexp_extract(text, '(\\d{4,})', 1) AS value_raw FROM pages_v WHERE regexp_matches(text, '\\d{4,}'))"
    pct2 = lambda b: f"CASE WHEN {b} > 0 THEN {round_even(f'100 * n_matched / {b}', 2)} ELSE 0 END::DOUBLE"
    out["local_recall"] = w(rules + ", " + both_v, f"SELECT *, {pct2('n_gold')} AS recall_pct, {pct2('n_found')} AS precision_pct FROM (SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM f JOIN g USING (document_id, page_number, value_raw)) AS n_matched)")
    stats = "count(*) AS n_requests, count(*) FILTER (outcome = 'view') AS n_ok, count(*) FILTER (outcome <> 'view') AS n_failed"
    out["latency_stats"] = w(REQUESTS, f"SELECT batch_id, {stats}, avg(latency_ms) AS mean_ms, quantile_cont(latency_ms, 0.5)::DOUBLE AS median_ms, max(latency_ms) AS max_ms, min(latency_ms) AS min_ms FROM req GROUP BY 1")
    out["provider_summary"] = w(REQUESTS, f"SELECT run_id, {stats}, {round_even('avg(latency_ms)', 1)} AS mean_ms, quantile_cont(latency_ms, 0.5)::DOUBLE AS median_ms, list_sort(list(latency_ms))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS p95_ms FROM req GROUP BY 1")
    out["failure_histogram"] = w(REQUESTS, "SELECT outcome, count(*) AS n FROM req WHERE outcome <> 'view' GROUP BY 1")
    status = "([200, 429, 400, 401, 403, 404, 408, 500, 503, 302, 200, NULL])[request_id % 12 + 1]"
    resp = REQUESTS + f", resp AS (SELECT *, {status} AS status FROM req)"
    out["failure_classes"] = w(resp, "SELECT CASE WHEN status IS NULL OR status = 408 THEN '408_TIMEOUT' WHEN status = 200 THEN CASE WHEN request_id % 5 > 0 THEN 'OK' ELSE 'STRUCTURED_OUTPUT_PARSE_ERROR' END WHEN status = 429 THEN '429_QUOTA_RATE_LIMIT' WHEN status = 400 THEN '400_REQUEST_SCHEMA' WHEN status IN (401, 403) THEN '401_403_AUTH_PERMISSION' WHEN status = 404 THEN '404_MODEL_NOT_FOUND' WHEN status >= 500 THEN '5XX_SERVER_ERROR' ELSE 'UNKNOWN_ERROR' END AS failure_class, count(*) AS n FROM resp GROUP BY 1")
    out["rate_limit_headers"] = w(REQUESTS, "SELECT request_id, '6000' AS limit_tokens, latency_ms::VARCHAR AS remaining_requests, NULL::VARCHAR AS reset_tokens, 2 AS n_headers FROM req")
    out["run_totals"] = w(resp, "SELECT run_id, count(*) AS n_requests, count(*) FILTER (status = 200) AS n_ok, count(*) FILTER (status <> 200) AS n_failed, count(*) FILTER (status = 429) AS n_429, count(*) FILTER (status = 503) AS n_503, sum(request_id % 3)::BIGINT AS n_retries FROM resp GROUP BY 1")
    kinds = {"n_requests": "MEASURED", "n_ok": "MEASURED", "n_failed": "MEASURED", "mean_ms": "MEASURED", "median_ms": "MEASURED", "p95_ms": "DERIVED"}
    long = " UNION ALL ".join(f"SELECT run_id, '{c}' AS metric, '{k}' AS classification, {c}::DOUBLE AS value FROM s" for c, k in kinds.items())
    long += "".join(f" UNION ALL SELECT run_id, '{c}', 'N/A', NULL FROM s" for c in ("precision", "recall"))
    out["provider_metrics"] = f"WITH s AS ({out['provider_summary']}) {long}"
    out["entities_by_type"] = "SELECT p_partkey, string_agg(l || '=' || ts, ';' ORDER BY l) AS entities FROM (SELECT p_partkey, l, string_agg(t, '+' ORDER BY i) AS ts FROM (SELECT p_partkey, 'len' || length(t) AS l, t, i FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)) GROUP BY 1, 2) GROUP BY 1"
    out["run_pivot"] = w(REQUESTS, f"SELECT *, {round_even('(run_0 + run_1 + run_2) / 3', 1)} AS mean_yield FROM (SELECT batch_id, count(*) FILTER (run_id = 0) AS run_0, count(*) FILTER (run_id = 1) AS run_1, count(*) FILTER (run_id = 2) AS run_2 FROM req GROUP BY 1)")
    out["speed_summary"] = w(REQUESTS, f"SELECT *, {round_even('mean_one / mean_other', 4)} AS speedup, {round_even('100 * (1 - mean_other / mean_one)', 2)} AS reduction_pct FROM (SELECT avg(latency_ms) FILTER (run_id = 0) AS mean_one, avg(latency_ms) FILTER (run_id = 1) AS mean_other, quantile_cont(latency_ms, 0.5) FILTER (run_id = 0)::DOUBLE AS median_one, quantile_cont(latency_ms, 0.5) FILTER (run_id = 1)::DOUBLE AS median_other FROM req)")
    out["interval_overlap"] = w(REQUESTS, "SELECT a.run_id, a.request_id, count(*) AS n_active FROM req a JOIN req b ON a.run_id = b.run_id AND NOT (a.end_ms < b.start_ms OR a.start_ms > b.end_ms) GROUP BY 1, 2")
    out["last_rate_limit"] = w(REQUESTS, "SELECT batch_id, arg_max(latency_ms, (start_ms, request_id)) FILTER (outcome = 'purchase') AS last_ms FROM req GROUP BY 1")
    sig = facts() + ", sigs AS (SELECT document_id, lower(concat_ws('|', 'p' || page_number % 10, canonical_entity, canonical_metric, replace(value_raw, '+', ''), coalesce(canonical_unit, unit, ''), period_label, coalesce(scope, ''), coalesce(geography, ''))) AS signature FROM facts_v), one AS (SELECT signature FROM sigs WHERE document_id = 'presentation'), two AS (SELECT signature FROM sigs WHERE document_id = 'press-note')"
    out["signature_union"] = w(sig, "SELECT * FROM one UNION SELECT * FROM two")
    out["signature_intersect"] = w(sig, "SELECT * FROM one INTERSECT SELECT * FROM two")
    out["signature_except"] = w(sig, "SELECT * FROM one EXCEPT SELECT * FROM two")
    out["signature_symmetric"] = w(sig, "(SELECT * FROM one EXCEPT SELECT * FROM two) UNION (SELECT * FROM two EXCEPT SELECT * FROM one)")
    runs = sig + ", bits AS (SELECT signature, bit_or(CASE document_id WHEN 'annual-report' THEN 1 WHEN 'presentation' THEN 2 ELSE 4 END)::BIGINT AS bitmap, min(document_id) AS first_run FROM sigs GROUP BY 1)"
    out["signature_runs"] = w(runs, "SELECT signature, bitmap, bit_count(bitmap)::INT AS n_runs, bitmap = 7 AS in_all, CASE WHEN bit_count(bitmap) = 1 THEN first_run END AS only_run FROM bits")
    out["signature_consistency"] = w(runs, "SELECT count(*) AS n_union, count(*) FILTER (bitmap = 7) AS n_common, count(*) FILTER (bitmap & 4 = 0) AS n_only_one, count(*) FILTER (bitmap & 3 = 0) AS n_only_other, count(*) FILTER (bitmap <> 7) AS n_inconsistent FROM bits")
    out["run_agreement"] = w(REQUESTS + ", fp AS (SELECT run_id, batch_id, substr(sha256((sum(latency_ms) % 2)::BIGINT::VARCHAR), 1, 16) AS f FROM req WHERE outcome = 'purchase' GROUP BY 1, 2)", "SELECT coalesce(a.batch_id, b.batch_id) AS batch_id, a.f AS fingerprint_one, b.f AS fingerprint_other, coalesce(a.f = b.f, false) AS is_equal FROM (SELECT * FROM fp WHERE run_id = 0) a FULL JOIN (SELECT * FROM fp WHERE run_id = 1) b ON a.batch_id = b.batch_id")

    out["read_analysis"] = w(RELATED, "SELECT relationship_id, relationship_type, a_fact_id AS fact_a_id, b_fact_id AS fact_b_id, fa.entity AS entity_a, fa.value_raw AS value_a, fb.entity AS entity_b, fb.value_raw AS value_b FROM related WHERE fa.canonical_unit = 'INR' AND fb.canonical_unit = 'INR'")
    whole = "lower(explanation || chr(10) || fa.entity || chr(10) || fa.metric || chr(10) || fa.value_raw || chr(10) || fb.entity || chr(10) || fb.metric || chr(10) || fb.value_raw)"
    out["relationship_search"] = w(RELATED, f"SELECT relationship_id, relationship_type FROM related WHERE contains({whole}, 'cror') UNION ALL SELECT relationship_id, relationship_type FROM related WHERE contains({whole}, 'limited') AND relationship_type = 'CONTRADICTS'")
    out["fact_search"] = w(claims(), "SELECT pos FROM claims_v WHERE contains(lower(supporting_text), 'restated') UNION ALL SELECT pos FROM claims_v WHERE contains(lower(supporting_text), 'crore') AND epistemic_status = 'reported'")
    out["indexed_relationship_search"], out["indexed_fact_search"] = out["relationship_search"], out["fact_search"]
    out["latest_per_key"] = w(claims(), "SELECT pos, value_raw, metric || '|' || period_label || '|' || page_number AS key FROM claims_v QUALIFY row_number() OVER (PARTITION BY metric, period_label, page_number ORDER BY pos DESC) = 1")
    out["document_overwrite"] = w(claims(), "SELECT document_id, CASE WHEN document_id = 'presentation' THEN 2 ELSE 1 END AS run, count(*) AS n, sum(pos)::BIGINT AS sum_pos FROM claims_v WHERE document_id <> 'presentation' OR scope IS NULL GROUP BY 1, 2")
    out["union_all_facts"] = w(claims(), "SELECT document_id, pos FROM claims_v")
    return out

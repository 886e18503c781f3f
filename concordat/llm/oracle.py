"""DuckDB SQL for the training-data queries that SQL can express.

There is none for op3 (best-fit search), op6 (a trained model), op7 and op13 (pair merging), op9 (XXH64 and
transitive links), op11 (eigenvectors) and the pipeline, which uses three of these; tests hold them
against brute force, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from . import licenses, quality_rules
from .queries import URL_RULES

WS = r"[\x20\x09-\x0D]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op1(alpha: float = quality_rules.ALPHA, delta: float = quality_rules.DELTA) -> str:
    ratios = {
        "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
    }
    long = lambda source, keep: " UNION ALL ".join(f"SELECT {keep}, stratum, '{r}' AS rule, {x} AS ratio FROM {source}" for r, x in ratios.items())
    cuts = ", ".join(f"('{r}', {i}, {c})" for i, (r, c) in enumerate(quality_rules.STEPS))
    pmf = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln({1 - alpha}))"
    return f"""WITH w AS (
  SELECT doc_id, coalesce(lang, {_q(quality_rules.NO_STRATUM.replace(chr(0), ''))}) AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], chr(1)) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)), twice AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS ks(k) GROUP BY 1), base AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
    SELECT w.doc_id, stratum, len(ws) AS n_words, length(regexp_replace(t, '{WS}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_shouts,
      md5(t) AS text_key FROM w LEFT JOIN cov USING (doc_id))), ratios AS ({long('base', 'doc_id')}), marks AS (
  SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1), labelled AS (
  SELECT * FROM base JOIN marks USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY text_key, stratum) = 1), units AS (
  SELECT *, max(q) OVER (PARTITION BY stratum, text_key) AS good FROM labelled WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY stratum, text_key ORDER BY doc_id) = 1), cuts AS (SELECT * FROM (VALUES {cuts}) AS c(rule, step, cutoff)), firsts AS (
  SELECT doc_id, min(step) AS step FROM ratios JOIN cuts USING (rule) WHERE ratio > cutoff GROUP BY 1), trials AS (
  SELECT units.stratum, good AS q, firsts.step AS first FROM units LEFT JOIN firsts USING (doc_id)), tests AS (
  SELECT stratum, step, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND first <= step) AS k, count(*) FILTER (q <> 1 AND first <= step) AS bad
  FROM trials, cuts GROUP BY ALL), proved AS (
  SELECT *, CASE WHEN k > n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: {pmf})) END <= {delta} / (SELECT count(DISTINCT stratum) FROM trials) AS ok FROM tests), certified AS (
  SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS held FROM proved), chosen AS (
  SELECT stratum, step FROM certified WHERE held AND bad > k QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - k DESC, step) = 1), broken AS (
  SELECT doc_id FROM base JOIN firsts USING (doc_id) JOIN chosen USING (stratum) WHERE firsts.step <= chosen.step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM base"""


OP2 = """WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n')) + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def _op4() -> str:
    fits = " ".join(
        f"WHEN (host = {_q(h)} OR ends_with(host, {_q('.' + h)})) AND starts_with(path, {_q(p)}) THEN {_q(a + ' ' + h + p)}"
        for a, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1].split(".")), -len(r[2])))
    )
    return f"""SELECT page_id, host, path, substr(hit, strpos(hit, ' ') + 1) AS rule, coalesce(split_part(hit, ' ', 1), 'allow') AS verdict FROM (
  SELECT *, CASE {fits} END AS hit FROM (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages))"""


def _op5() -> str:
    host = "lower(regexp_extract(bare, '(?s)^[^:/?]*://([^/?]*)', 1))"
    return rf"""WITH p AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '(?s)#.*$', '') AS bare, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS etag, 'sha256:' || sha256(coalesce(html, '')) AS digest,
    1704067200 + page_id % 365 * 86400 + page_id % 86400 AS t0, CASE WHEN page_id % 11 = 0 THEN 1700000000 + page_id % 86400 ELSE 1704067200 + page_id % 365 * 86400 + page_id % 86400 + 3600 + page_id % 30 * 86400 END AS t1 FROM pages), k AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|gclid|fbclid)(?:=|$)'))) AS kept,
    regexp_replace(CASE WHEN bare ILIKE 'https://%' THEN regexp_replace({host}, ':443$', '') WHEN bare ILIKE 'http://%' THEN regexp_replace({host}, ':80$', '') ELSE {host} END, '^www\d*\.', '') || regexp_replace(regexp_extract(bare, '(?s)^[^:/?]*://[^/?]*([^?]*)', 1), '/+$', '') AS front FROM p), c AS (
  SELECT *, front || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS u FROM k), hits AS (
  SELECT v.page_id, v.u, v.t1, s.page_id AS sid, s.t0, s.digest, s.etag, CASE WHEN v.page_id % 5 = 0 THEN NULL WHEN v.page_id % 7 = 0 THEN '"changed"' ELSE v.etag END AS said
  FROM c v LEFT JOIN c s ON v.u = s.u AND v.u <> '' AND s.t0 < v.t1 QUALIFY row_number() OVER (PARTITION BY v.page_id ORDER BY s.t0 DESC NULLS LAST, 'urn:response:' || s.page_id DESC) = 1), o AS (
  SELECT *, CASE WHEN sid IS NULL THEN 'no_response' WHEN said IS NULL THEN 'unvalidated' WHEN said = etag THEN 'resolved' ELSE 'changed' END AS outcome FROM hits)
SELECT 'urn:revisit:' || page_id AS record_id, u AS url, t1 AS revisit_time, outcome, 'urn:response:' || sid AS response_id, t0 AS response_time, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || page_id % 1000 || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || etag END AS headers FROM o"""


OP8 = """WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM d QUALIFY rank <= 10"""


def _op10() -> str:
    def canonical(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        x = f"regexp_replace({x}, '{licenses.COPYRIGHT_LINE}', '', 'g')"
        x = rf"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
        for pattern, one in licenses.spelling_patterns("\\"):
            x = rf"regexp_replace({x}, '\b{pattern}(s?)\b', '{one}\{2 if '(' in pattern else 1}', 'g')"
        return x

    flat = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    known = [(i, t) for i, ts in licenses.NOTICES.items() for t in ts] + list(licenses.TEXTS.items())
    rows = ", ".join(f"({_q(i)}, {_q(t)})" for i, t in known)
    return rf"""WITH lib AS (SELECT sha256({flat('c')}) AS digest, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM (SELECT id, {canonical('t')} AS c FROM (VALUES {rows}) AS k(id, t)) GROUP BY 1), d AS (
  SELECT doc_id, {canonical('text')} AS c FROM documents), ls AS (SELECT doc_id, unnest(list_concat(string_split(c, chr(10)), regexp_split_to_array(c, '\n\n+'))) AS l FROM d), hits AS (
  SELECT doc_id, unnest(string_split(ids, ',')) AS id FROM ls JOIN lib ON sha256({flat('l')}) = digest WHERE trim(l) <> ''), notes AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS notice_licenses FROM hits GROUP BY 1)
SELECT d.doc_id, sha256({flat('d.c')}) AS canonical_sha256, lib.ids AS whole_license, notice_licenses FROM d LEFT JOIN lib ON sha256({flat('d.c')}) = digest LEFT JOIN notes ON notes.doc_id = d.doc_id"""


OP12 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, false)::INT AS mask, count(*) AS n FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL), letters AS (SELECT unnest(range(5)) AS x), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5), f AS (
  SELECT part, o, s, o[s] AS bit, n, good, toxic, mask, mask >> o[s] & 1 = 1 AS fails, coalesce(list_sum(list_transform(o[1:s - 1], lambda i: mask >> i & 1)), 0) > 0 AS gone FROM m, orders, range(1, 6) AS steps(s)), sums AS (
  SELECT part, o, s, bit, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = 1 << bit), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM f GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda x: chr((65 + x)::INT)), '') AS filter_order, s::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM sums"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _op1(),
        "op2_chat_formatting": OP2,
        "op4_url_filter": _op4(),
        "op5_warc_revisits": _op5(),
        "op8_nearest_neighbours": OP8,
        "op10_license_scan": _op10(),
        "op12_filter_audit": OP12,
    }

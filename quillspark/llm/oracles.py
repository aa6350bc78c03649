"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quillspark.llm.licenses import LOWER, NOT_WORD, TEMPLATES, THRESHOLD, UPPER, template_sets
from quillspark.llm.url_filter import RULES, SOFT_TERMS, STRICT_TERMS


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _url_sql() -> str:
    def found(term: str) -> str:
        pattern = r"(^|[^\p{L}\p{N}])" + term.replace(".", r"\.") + r"([^\p{L}\p{N}]|$)"
        return f"regexp_matches(low, {_quoted(pattern)})::INT"

    rules = sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = {_quoted(h)} OR suffix(host, {_quoted('.' + h)})) AND prefix(path, {_quoted(p)})"
    rule = " ".join(f"WHEN {fits(h, p)} THEN {_quoted(h + p)}" for _, h, p in rules)
    verdict = " ".join(f"WHEN rule = {_quoted(h + p)} THEN {_quoted(v)}" for v, h, p in rules)
    strict = " + ".join(map(found, sorted(set(STRICT_TERMS))))
    soft = " + ".join(map(found, sorted(set(SOFT_TERMS) - set(STRICT_TERMS))))
    return rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_quoted(UPPER)}, {_quoted(LOWER)}) AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
         translate(translate(host || path, {_quoted(UPPER)}, {_quoted(LOWER)}), '_.', '--') AS low
  FROM hosts
)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN {strict} >= 1 OR {soft} >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


_WORDS = r"'[^ \t\n\x0B\f\r]+'"

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_WORDS}) AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines FROM d),
grams AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i+1], words[i+2]) AS n FROM grams),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS s(k) WHERE n >= 2 GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: octet_length(encode(x)) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_caps,
         len(list_filter(words, lambda x: suffix(x, '!!'))) AS n_shouts
  FROM w LEFT JOIN covered USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits AS failed_bits,
       n_lines::BIGINT AS n_lines, n_caps::BIGINT AS n_caps_words, n_shouts::BIGINT AS n_shouts,
       concat_ws(',', CASE WHEN bits & 3 = 0 THEN 'base' END, CASE WHEN bits & 15 = 0 THEN 'v1' END, CASE WHEN bits = 0 THEN 'v2' END) AS kept_by,
       CASE bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'capitals'
         WHEN 32 THEN 'shouting' WHEN 64 THEN 'short_words' WHEN 128 THEN 'long_words' END AS sole_rule
FROM (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT
  + 8 * (2 * n_dup_lines > n_lines)::BIGINT + 16 * (2 * n_caps > n_words)::BIGINT + 32 * (4 * n_shouts > n_words)::BIGINT
  + 64 * (word_chars < 2 * n_words)::BIGINT + 128 * (word_chars > 25 * n_words)::BIGINT) AS bits FROM m)
"""


def _license_sql() -> str:
    templates = ", ".join(
        f"({t}, {_quoted(label)}, {len(s)}, {step}, [{', '.join(map(_quoted, sorted(s)))}])" for t, (label, s, step) in enumerate(template_sets(TEMPLATES))
    )
    at = lambda k, w: f"words[i+{k}] = {_quoted(w)}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), {_quoted(UPPER)}, {_quoted(LOWER)}) AS t FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, {_quoted(NOT_WORD)}), lambda x: x <> '') AS words FROM d),
places AS (
  SELECT r, i - 1 AS start, CASE WHEN {at(0, "mit")} AND {at(1, "license")} THEN 'mit'
    WHEN {at(0, "apache")} AND {at(1, "license")} THEN 'apache'
    WHEN {at(0, "general")} AND {at(1, "public")} AND {at(2, "license")} THEN 'gpl' END AS label
  FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_contains(words, 'license'))
),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places WHERE label IS NOT NULL GROUP BY r),
templates(t, label, n, step, terms) AS (VALUES {templates}),
blocks AS (SELECT r, step, list_distinct(words[k*step+1 : k*step+2*step]) AS b FROM (
  SELECT r, words, step, unnest(range(0, greatest(1, ceil((len(words) - 2 * step) / step::DOUBLE)::INT + 1))) AS k
  FROM w, (SELECT DISTINCT step FROM templates) WHERE list_has_any(words, (SELECT flatten(list(terms)) FROM templates)))),
found AS (SELECT r, label, len(list_intersect(terms, b)) / n::DOUBLE AS c FROM blocks JOIN templates USING (step)
  WHERE list_has_any(b, terms) AND len(list_intersect(terms, b)) >= greatest(1, ceil({THRESHOLD} * n - 1e-9))),
method AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS c FROM found GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(method.c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN method USING (r)
"""


_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS head FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM h
"""


_SUBSTRINGS = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(words[i : i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
f AS (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS head FROM s),
gone AS (SELECT r, list(DISTINCT i + k) AS places FROM f, range(0, 13) AS t(k) WHERE head < doc_id GROUP BY r),
k AS (SELECT doc_id, words, coalesce(gone.places, []) AS places FROM w LEFT JOIN gone USING (r))
SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(places, i)), ' '), '')) AS kept_sha256
FROM k
"""


SQL = {
    "op2_license_scan": _license_sql(),
    "op3_quality_rules": _QUALITY,
    "op7_warc": _WARC,
    "op8_url_filter": _url_sql(),
    "op9_substring_dedup": _SUBSTRINGS,
}

"""The corpus queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .line_dedup import MIN_SITES
from .quality import MAX_REPEAT_PERCENT, MIN_WORDS, STOP_WORDS, THRESHOLDS

_SPACE = r"' ' || chr(9) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, source, pos, trim(parts[pos], {_SPACE}) AS line
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS pos FROM d WHERE doc_id IS NOT NULL)
  WHERE trim(parts[pos], {_SPACE}) <> ''
),
spread AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS n FROM lines SEMI JOIN spread USING (line)),
gone AS (SELECT doc_id, list(pos) AS gone FROM ranked WHERE n > 1 GROUP BY doc_id),
rest AS (
  SELECT d.doc_id, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text
         ELSE array_to_string([parts[i] for i in range(1, len(parts) + 1) if NOT list_contains(gone, i)], chr(10)) END AS text
  FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(text) AS BIGINT) AS n_chars_left, sha256(text) AS text_sha256 FROM rest
"""

URL_RULES = r"""
WITH RECURSIVE tags AS (
  SELECT url, regexp_extract_all(html, '(?is)<link\b[^>]*') AS links, regexp_extract_all(html, '(?is)<meta\b[^>]*') AS metas FROM pages WHERE html IS NOT NULL AND contains(url, '://')
),
named AS (
  SELECT url, list_filter(links, lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b') AND regexp_matches(x, '(?is)\bhref\s*=\s*["'']?[^"''\s>]'))[1] AS link,
    list_filter(metas, lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') AND regexp_matches(x, '(?is)\burl\s*=\s*["'']?[^"''\s>;]'))[1] AS meta FROM tags
),
targets AS (
  SELECT url, regexp_extract(link, '(?is)^<link\b.*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM named WHERE link IS NOT NULL
  UNION ALL SELECT url, regexp_extract(meta, '(?is)^<meta\b.*\burl\s*=\s*["'']?([^"''\s>;]+)', 1) FROM named WHERE meta IS NOT NULL
),
placed AS (
  SELECT url, target, regexp_extract(url, '^[^/?#]*//[^/?#]*', 0) AS root, split_part(url, '//', 1) AS scheme, regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS path FROM targets
),
whole AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN scheme || target WHEN starts_with(target, '/') THEN root || target
    ELSE regexp_replace(root || path, '^([^/]*//[^/]*(?:/.*)?)/[^/]*$', '\1') || '/' || target END AS target FROM placed
),
ends AS (SELECT CASE WHEN contains(url, '://') THEN split_part(url, '#', 1) END AS u, CASE WHEN contains(target, '://') THEN split_part(target, '#', 1) END AS v FROM whole),
edges AS (SELECT u, v FROM ends WHERE u <> v UNION SELECT v, u FROM ends WHERE u <> v),
reach AS (SELECT u AS node, u AS other FROM edges UNION SELECT node, v FROM reach JOIN edges ON other = u),
urls AS (SELECT url FROM pages UNION SELECT u FROM edges),
rests AS (SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM urls),
p AS (
  SELECT url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rests
),
r(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT url, host, path, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
best AS (SELECT url, host, path, rule, action FROM fits WHERE n = 1),
blocked AS (SELECT node FROM reach JOIN best ON other = url GROUP BY node HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), FALSE))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN best ON pages.url IS NOT DISTINCT FROM best.url LEFT JOIN blocked ON contains(pages.url, '://') AND node = split_part(pages.url, '#', 1)
"""

_FAILED = ", ".join(f"CASE WHEN NOT ({t.part} / nullif({t.whole}, 0) BETWEEN {t.low} AND {t.high}) THEN '{t.name}' END" for t in THRESHOLDS)

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], x))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN repeated USING (doc_id)
),
v AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    array_to_string(list_filter([{_FAILED}], lambda x: x IS NOT NULL), ',') AS failed
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v
"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
b AS (SELECT item_id, words, least(len(words), 13) AS n FROM (SELECT item_id, coalesce({_WORDS}, []) AS words FROM benchmark) WHERE len(words) > 0),
w AS (
  SELECT n, window_text, list(DISTINCT item) AS items
  FROM (SELECT n, CAST(item_id AS VARCHAR) AS item, array_to_string(words[i:i + n - 1], ' ') AS window_text FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM b))
  GROUP BY n, window_text
),
sizes AS (SELECT DISTINCT n FROM w),
places AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS window_text FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, n, items FROM places JOIN w USING (n, window_text)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM (SELECT doc_id, unnest(items) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), FALSE) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

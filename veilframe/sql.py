"""The registered queries in DuckDB SQL, where SQL can express them.

DuckDB's patterns have no lookaround: the e-mail pattern and the token formats are rewritten with delimiters that are taken up, which differs
only where two findings share one.
"""

from __future__ import annotations

import ipaddress
import re

from .functions.filters import DNS_SERVERS, MAPPED, NOT_PRIVATE, NOT_PRIVATE_V6, PRIVATE_NETWORKS, PRIVATE_V6
from .functions.patterns import IPV4, IPV6
from .operators.plugins import ID_NAME, PLUGINS, SEQUENCES, TEMPLATED, UUID
from .queries import shape_part, token_shapes


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_IP = r"(?m)(^|[\x08\s@?,!;:'\")(.\p{Han}])(" + IPV4 + "|" + IPV6 + r")($|[\s@,?!;:'\"(.\p{Han}])"
_LOCAL = r"[^\]\[(){}<>\x08\s@,?!;'\":#/\\=.\-]"
_EMAIL = (
    r"(?m)(^|[\[({<\x08\s@,?!;'\"\p{Han}¿¡:.]|\\['\"])"
    + rf"((?:(?:[=.\-][=\-]*)?{_LOCAL})+@"
    + r"(?:(?:\w|[^.\x08\s@?!;,/()>\-:][^.\x08\s@?!;,/()>]{0,62}[^.\x08\s@?!;,/()>\-:'\"])\.){1,10}(?:[\p{L}\p{M}]{2,63}|xn--\w+))"
    + r"($|[\])}>\x08\s@,?!;'\"\p{Han}]|\\['\"]|:(?:\D|$)|\.(?:\s|$))"
)


def _matches(name: str, pattern: str, source: str) -> str:
    """CTEs: name has doc_id, text, start, end, value of the second group's matches in source (doc_id, text)."""
    marked = f"regexp_replace(text, {_quoted(pattern)}, '\\1' || chr(64976) || '\\2' || chr(64976) || '\\3', 'g')"
    return f"""
{name}_pieces AS (SELECT doc_id, text, string_split({marked}, chr(64976)) AS pieces FROM ({source})),
{name}_at AS (SELECT doc_id, text, pieces, unnest(range(2, len(pieces) + 1, 2)) AS i FROM {name}_pieces WHERE len(pieces) > 1),
{name} AS (
  SELECT doc_id, text, CAST(coalesce(list_sum([length(x) for x in pieces[1:i - 1]]), 0) AS INTEGER) AS start,
    CAST(coalesce(list_sum([length(x) for x in pieces[1:i]]), 0) AS INTEGER) AS "end", pieces[i] AS value
  FROM {name}_at
)"""


def _wrapped(start: str, end: str) -> str:
    low = f"(CASE WHEN {start} >= 100 THEN {start} - 100 ELSE greatest(length(text) + {start} - 100, 0) END)"
    high = f"least({end} + 100, length(text))"
    return f"(CASE WHEN {low} < {high} THEN substr(text, CAST({low} AS BIGINT) + 1, CAST({high} - {low} AS BIGINT)) ELSE '' END)"


_OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
_VALID = rf"regexp_full_match(value, '(?:{_OCTET}\.){{3}}{_OCTET}')"


def _private_number(number: str) -> str:
    ranges = [f"{number} BETWEEN {int(x[0])} AND {int(x[-1])}" for x in map(ipaddress.ip_network, PRIVATE_NETWORKS)]
    return f"(({' OR '.join(ranges)}) AND {number} NOT IN ({', '.join(str(int(ipaddress.ip_address(x))) for x in NOT_PRIVATE)}))"


def _v4_number(value: str) -> str:
    return f"list_reduce([CAST(x AS BIGINT) for x in string_split({value}, '.')], lambda a, x: a * 256 + x)"


def _private() -> str:
    return _private_number(_v4_number("value"))


_EXCLUDED = f"(CASE WHEN NOT {_VALID} THEN TRUE ELSE {_private()} OR value IN ({', '.join(map(_quoted, DNS_SERVERS))}) END)"
_DATE = r"regexp_matches(value, '^[0-3]\d\.[0-3]\d\.\d\d\.')"
_DOTS = "length(value) - length(replace(value, '.', '')) = 3"
_VERSION = f"(length(value) = 7 AND {_DOTS} AND NOT (contains(lower({_wrapped('start', '\"end\"')}), 'dns') OR contains(lower({_wrapped('start', '\"end\"')}), 'server')))"
_ADDRESS = rf"regexp_matches(value, '\d') AND NOT {_DATE} AND NOT {_VERSION} AND {_VALID}"


def _inside(networks: tuple[str, ...]) -> str:
    ranges = [f"digits BETWEEN '{int(x[0]):032x}' AND '{int(x[-1]):032x}'" for x in map(ipaddress.ip_network, networks)]
    return f"({' OR '.join(ranges)})"


#: CTEs: kinds has value and kind (invalid, private or public) of the addresses in ip.
_KINDS = rf"""
bare AS (SELECT value, lower(split_part(value, '%', 1)) AS bare FROM (SELECT DISTINCT value FROM ip WHERE contains(value, ':'))),
tails AS (SELECT value AS address, bare, regexp_extract(bare, '[^:]*$') AS value FROM bare),
plain AS (
  SELECT address, CASE WHEN NOT contains(value, '.') THEN bare
    WHEN {_VALID} THEN substr(bare, 1, length(bare) - length(value)) || printf('%x:%x', {_v4_number('value')} // 65536, {_v4_number('value')} % 65536) END AS plain FROM tails
),
sides AS (SELECT address, plain, string_split(plain, '::') AS sides FROM plain),
parts AS (
  SELECT address, sides, CASE WHEN sides[1] = '' THEN [] ELSE string_split(sides[1], ':') END AS a, CASE WHEN len(sides) < 2 OR sides[2] = '' THEN [] ELSE string_split(sides[2], ':') END AS b FROM sides WHERE plain IS NOT NULL
),
filled AS (
  SELECT address, array_to_string([lpad(x, 4, '0') for x in list_concat(a, ['0' for i in range(0, 8 - len(a) - len(b))], b)], '') AS digits FROM parts
  WHERE len(list_filter(list_concat(a, b), lambda x: NOT regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 0
    AND CASE len(sides) WHEN 1 THEN len(a) = 8 WHEN 2 THEN len(a) + len(b) <= 7 ELSE FALSE END
),
v6 AS (SELECT address, CASE WHEN {_inside((MAPPED,))} THEN {_private_number("CAST('0x' || substr(digits, 25, 8) AS BIGINT)")} ELSE {_inside(PRIVATE_V6)} AND NOT {_inside(NOT_PRIVATE_V6)} END AS private FROM filled),
kinds AS (
  SELECT value, CASE WHEN contains(value, ':') THEN CASE WHEN address IS NULL THEN 'invalid' WHEN private THEN 'private' ELSE 'public' END
    WHEN NOT {_VALID} THEN 'invalid' WHEN {_private()} THEN 'private' ELSE 'public' END AS kind
  FROM (SELECT DISTINCT value FROM ip) LEFT JOIN v6 ON address = value
)"""

_DOCS, _PAGES = "SELECT doc_id, text FROM documents", "SELECT page_id AS doc_id, html AS text FROM pages"
_SPAN = 'doc_id, start, "end", value'
#: CTEs: words has doc_id, pos, value, start and end of every word.
_WORDS = r"""
word_pieces AS (SELECT doc_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS p FROM documents)),
word_places AS (SELECT doc_id, i, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS until FROM word_pieces),
words AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, part AS value, CAST(until - length(part) AS INTEGER) AS start, until AS "end"
  FROM word_places WHERE NOT regexp_matches(part, '^[\x20\x09-\x0D]')
)"""
# Without the look-ahead that keeps the pattern from paths, of which the provided documents have none.
_KEY = r"(?m)()((?:(?:[A-Za-z]+[\p{Nd}\p{Pd}/+=:_]+|[\p{Nd}\p{Pd}/+=:]+[A-Za-z]+)){4,})($|[\x08\s\p{Han}@?,!;:'\")(.])"
_BIGRAMS = """
pairs AS (SELECT substr(run, i, 1) AS a, substr(run, i + 1, 1) AS b, count(*) AS n FROM (
  SELECT run, unnest(range(1, length(run))) AS i FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS run FROM documents)) GROUP BY ALL),
model AS (SELECT a || b AS pair, ln(n / sum(n) OVER (PARTITION BY a)) AS log_p FROM pairs),
unseen AS (SELECT ln(least(1.0, min(0.5 / t))) AS log_p FROM (SELECT sum(n) AS t FROM pairs GROUP BY a))"""

_KEYS = f"""{_matches("key", _KEY, _DOCS)}, {_BIGRAMS},
shapes AS (SELECT DISTINCT value, regexp_replace(lower(value), '[^a-z]+', '', 'g') AS s FROM key),
key_scores AS (SELECT value, avg(-coalesce(model.log_p, unseen.log_p)) AS score FROM (SELECT value, unnest([s[i:i + 1] for i in range(1, length(s))]) AS pair FROM shapes) LEFT JOIN model USING (pair), unseen GROUP BY value)"""


def _scores(name: str, source: str) -> str:
    """CTEs: name has value and score of the values in source."""
    return f"""
{name}_letters AS (SELECT DISTINCT value, regexp_replace(lower(value), '[^a-z]+', '', 'g') AS s FROM ({source})),
{name} AS (SELECT value, avg(-coalesce(model.log_p, unseen.log_p)) AS score FROM (SELECT value, unnest([s[i:i + 1] for i in range(1, length(s))]) AS pair FROM {name}_letters) LEFT JOIN model USING (pair), unseen GROUP BY value)"""


def _without_lookahead(pattern: str) -> str:
    return re.sub(r"\(\?=\$\|(\[[^\]]*\])\)", r"(?:$|\1)", re.sub(r"\(\?!\[([^\]]*)\]\)", r"(?:[^\1]|$)", pattern))


def _json_part(i: int) -> str:
    plain = f"translate(rtrim(string_split(value, '.')[{i}], '='), '-_', '+/')"
    return f"coalesce(json_valid(TRY(decode(from_base64(rpad({plain}, CAST(ceil(length({plain}) / 4.0) * 4 AS INTEGER), '='))))), FALSE)"


_BEFORE = "string_split(substr(text, 1, strpos(text, value) - 1), chr(10))[-1]"
_ON_HASH_LINE = f"(length(value) IN (32, 40, 64) AND regexp_matches(lower({_BEFORE}), 'sha|md5|hash|byte'))"


def _plugin_values(source: str) -> str:
    """CTEs: secrets has doc_id, text and the different values that the plugins find in source (doc_id, text) and the filters leave."""
    found = " UNION ALL ".join(f"SELECT doc_id, text, '{p.name}' AS plugin, unnest(regexp_extract_all(text, {_quoted(_without_lookahead(p.pattern))}, 1)) AS value FROM plugin_source" for p in PLUGINS)
    sequences = " OR ".join(f"contains('{x}', upper(value))" for x in SEQUENCES)
    return f"""
plugin_source AS ({source}),
plugin_found AS (SELECT DISTINCT * FROM ({found}) WHERE value <> ''),
plugin_signs AS (SELECT value, sign, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS sign FROM (SELECT DISTINCT value FROM plugin_found)) GROUP BY ALL),
plugin_entropy AS (SELECT value, -sum(n / length(value) * log2(n / length(value))) AS entropy FROM plugin_signs GROUP BY value),
secrets AS (
  SELECT DISTINCT doc_id, text, value FROM plugin_found JOIN plugin_entropy USING (value)
  WHERE CASE plugin WHEN 'Base64HighEntropyString' THEN entropy > 4.5
      WHEN 'HexHighEntropyString' THEN entropy - CASE WHEN regexp_full_match(value, '[0-9]{{2,}}') THEN 1.2 / log2(length(value)) ELSE 0 END > 3.0
      WHEN 'JwtTokenDetector' THEN {_json_part(1)} AND {_json_part(2)} ELSE TRUE END
    AND NOT regexp_matches(value, {_quoted(UUID)}) AND NOT regexp_matches({_BEFORE}, {_quoted(ID_NAME)}) AND NOT regexp_matches(value, {_quoted(TEMPLATED)}) AND NOT ({sequences})
)"""


def _secret_spans(limit: float) -> str:
    """CTEs: secret_spans has doc_id, start, end and value of the occurrences of the documents' secrets."""
    return f"""{_plugin_values(_DOCS)}, {_BIGRAMS}, {_scores("secret_scores", "SELECT value FROM secrets")},
secret_texts AS (SELECT doc_id, value, string_split(text, value) AS pieces FROM secrets JOIN secret_scores USING (value) WHERE score > {limit} AND NOT {_ON_HASH_LINE} AND NOT ({_dense()})),
secret_spans AS (
  SELECT doc_id, value, CAST(list_sum([length(x) for x in pieces[1:i]]) + (i - 1) * length(value) AS INTEGER) AS start, CAST(list_sum([length(x) for x in pieces[1:i]]) + i * length(value) AS INTEGER) AS "end"
  FROM (SELECT doc_id, value, pieces, unnest(range(1, len(pieces))) AS i FROM secret_texts)
)"""


def _hash_count(word: str) -> str:
    return f"(length(lower(text)) - length(replace(lower(text), '{word}', ''))) // {len(word)}"


def _dense() -> str:
    limit = "CAST(floor((length(text) - length(replace(text, chr(10), ''))) * 0.02) AS BIGINT)"
    return f"{_hash_count('sha')} > {limit} OR {_hash_count('hash')} > {limit}"


def _findings(*branches: str) -> str:
    return f"""
found AS (
  SELECT d.doc_id, source || '/' || CAST(d.doc_id AS VARCHAR) || '.txt' AS filename, start, "end", type, value AS text FROM (
    SELECT doc_id, start, "end", 'IP_ADDRESS' AS type, value FROM ip WHERE {_ADDRESS} AND NOT {_EXCLUDED}
    UNION SELECT doc_id, start, "end", 'EMAIL', value FROM mail
    {" ".join("UNION " + x for x in branches)}
  ) f JOIN documents d USING (doc_id)
)"""


_HOME = _matches("home", r"(\\?/home\\?/)(src1)()", _DOCS)
_FOUND = f"""
WITH {_matches("ip", _IP, _DOCS)}, {_matches("mail", _EMAIL, _DOCS)}, {_KEYS},
{_findings("""SELECT doc_id, start, "end", 'KEY', value FROM key JOIN key_scores USING (value) WHERE score > 4.0""")}"""
_DEFAULT = f"""
WITH {_matches("ip", _IP, _DOCS)}, {_matches("mail", _EMAIL, _DOCS)}, {_HOME}, {_secret_spans(4.0)}"""
_DEFAULT_BRANCHES = ("""SELECT doc_id, start, "end", 'KEY', value FROM secret_spans""", """SELECT doc_id, start, "end", 'NAME', value FROM home""")
_SCANNED = f"{_DEFAULT}, {_findings(*_DEFAULT_BRANCHES)}"

_TRIMMED = r"""regexp_replace(CASE WHEN tag = 'KEY' THEN cut ELSE regexp_replace(cut, '[^\p{L}\p{M}\p{N}_]+$', '') END, '^\s+|\s+$', '', 'g')"""
_CUT = r"""regexp_replace(old, '^[!"''()*+,\-./:;<=>?\[\\\]^_`{|}~]+', '')"""
_WORDS_IN_VALUE = "len(list_filter(regexp_split_to_array(value, '\\s+'), lambda x: x <> ''))"
_MODEL_BRANCH = f"""{_WORDS},
tagged AS (SELECT *, ['O', 'B-NAME', 'I-NAME', 'B-KEY', 'I-KEY', 'B-EMAIL', 'I-EMAIL'][(length(value) * 7 + unicode(value)) % 7 + 1] AS label FROM words),
prefixed AS (SELECT doc_id, pos, start, "end", label[1:1] AS prefix, CASE WHEN label = 'O' THEN '_' ELSE label[3:] END AS type FROM tagged),
followed AS (SELECT *, lag(prefix, 1, 'O') OVER w AS before, lag(type) OVER w AS type_before FROM prefixed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
run_of AS (SELECT *, sum(CASE WHEN prefix = 'B' OR before = 'O' OR type <> type_before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM followed WHERE prefix <> 'O'),
runs AS (SELECT doc_id, type AS tag, min(start) AS s, max("end") AS e FROM run_of GROUP BY doc_id, run, type),
spelled AS (SELECT doc_id, tag, s, substr(text, s + 1, e - s) AS old FROM runs JOIN documents USING (doc_id)),
cuts AS (SELECT *, {_CUT} AS cut FROM spelled),
trimmed AS (SELECT doc_id, tag, s, old, {_TRIMMED} AS value FROM cuts),
{_scores("entity_scores", "SELECT value FROM trimmed WHERE tag = 'KEY'")},
entities AS (
  SELECT doc_id, tag, value, CAST(s + greatest(strpos(old, value) - 1, 0) AS INTEGER) AS start, CAST(s + greatest(strpos(old, value) - 1, 0) + length(value) AS INTEGER) AS "end" FROM trimmed LEFT JOIN entity_scores USING (value)
  WHERE length(value) > 3 AND CASE tag WHEN 'KEY' THEN length(value) > 8 AND coalesce(score > 4.0, FALSE) WHEN 'NAME' THEN {_WORDS_IN_VALUE} > 1 ELSE TRUE END
)"""


def _shape(parts: tuple[str, ...]) -> str:
    column = {"h": "h_", "up": "up_", "m": "m_"}
    return " || ".join(f"substr({column[found[0]]}, {found[1]}, {found[2] - found[1] + 1})" if (found := shape_part(x)) else _quoted(x) for x in parts)


_SHAPES = " UNION ALL ".join(f"SELECT doc_id || '/{k}' AS doc_id, {_shape(v)} AS text FROM digests" for k, v in token_shapes().items())

_MASK = """list_reduce(
    list_prepend({'a': 0, 'b': 0, 'kind': '', 'at': 0, 'out': '', 'known': MAP {chr(1): ''}}, [{'a': x.a, 'b': x.b, 'kind': x.kind, 'at': 0, 'out': '', 'known': MAP {chr(1): ''}} for x in spans]),
    lambda s, x: CASE WHEN x.b < s.at THEN s ELSE {
      'a': 0, 'b': 0, 'kind': '', 'at': x.b,
      'out': s.out || (CASE WHEN x.a <= s.at OR s.at >= length(text) THEN ' ' ELSE substr(text, s.at + 1, x.a - s.at) END)
        || coalesce(s.known[substr(text, x.a + 1, x.b - x.a)], '<' || x.kind || '_MASK>'),
      'known': map_concat(MAP {substr(text, x.a + 1, x.b - x.a): coalesce(s.known[substr(text, x.a + 1, x.b - x.a)], '<' || x.kind || '_MASK>')}, s.known)
    } END)"""

_BRANCHES = f"""{_WORDS},
a AS (SELECT doc_id, CASE WHEN pos % 4 = 0 THEN 'EMAIL' ELSE 'KEY' END AS tag, value, start, "end" FROM words WHERE pos % 2 = 0),
b AS (SELECT doc_id, CASE WHEN length(value) % 2 = 0 THEN 'EMAIL' ELSE 'NAME' END AS tag, value, start, "end" FROM words WHERE pos % 3 = 0),
merged AS (SELECT * FROM a UNION SELECT * FROM b)"""

_COMBINED = r"""
docs AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents),
offsets AS (SELECT doc_id, n_tokens, unnest(range(0, n_tokens, 48)) AS off FROM docs),
cells AS (SELECT doc_id, n_tokens, off + i AS pos, k AS label_no, CAST((doc_id + off + i * 3 + k * 5) % 8 + 1 AS DOUBLE) AS p FROM offsets, range(0, 64) x(i), range(0, 3) y(k)),
summed AS (SELECT doc_id, pos, label_no, sum(p) AS p FROM cells WHERE pos < n_tokens GROUP BY ALL),
combined AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(label_no AS INTEGER) AS label_no, p / sum(p) OVER (PARTITION BY doc_id, pos) AS p FROM summed)"""


ORACLES: dict[str, str] = {
    "ip_spans": f"WITH {_matches('ip', _IP, _DOCS)} SELECT {_SPAN} FROM ip WHERE {_ADDRESS}",
    "ip_public_spans": f"WITH {_matches('ip', _IP, _DOCS)} SELECT {_SPAN} FROM ip WHERE {_ADDRESS} AND NOT {_EXCLUDED}",
    "ip_page_spans": f"WITH {_matches('ip', _IP, _PAGES)} SELECT {_SPAN} FROM ip WHERE {_ADDRESS}",
    "email_spans": f"WITH {_matches('mail', _EMAIL, _DOCS)} SELECT {_SPAN} FROM mail",
    "email_page_spans": f"WITH {_matches('mail', _EMAIL, _PAGES)} SELECT {_SPAN} FROM mail",
    "key_shapes": f"WITH {_matches('key', _KEY, _DOCS)} SELECT {_SPAN} FROM key",
    "key_spans": f"WITH {_KEYS} SELECT {_SPAN} FROM key JOIN key_scores USING (value) WHERE score > 4.0",
    "home_name_spans": "WITH "
    + _matches("home", r"(\\?/home\\?/)(src1)()", r"SELECT doc_id, 'see /home/' || source || '/x and \/home\/' || source || ':2 ' || text AS text FROM documents")
    + f" SELECT {_SPAN} FROM home",
    "hash_gate": f"SELECT doc_id, {_dense()} AS dense FROM documents",
    "hash_lines": f"""
WITH v AS (SELECT doc_id, text, substr(sha256(text) || md5(text), 1, [32, 40, 64, 31, 41][doc_id % 5 + 1]) AS value FROM documents),
t AS (SELECT doc_id, value, text || chr(10) || ['MD5 sum ', 'total ', 'a byte of ', 'hash' || chr(10), 'SHA: ', 'sh a ', ''][doc_id % 7 + 1] || value || chr(10) || 'sha ' || value AS text FROM v)
SELECT doc_id, {_ON_HASH_LINE} AS on_hash_line FROM t""",
    "literal_occurrences": """
WITH v AS (SELECT doc_id, text, lower(regexp_extract(text, '^[A-Za-z]+', 0)) AS v FROM documents),
p AS (SELECT doc_id, text, v, CASE WHEN v = '' THEN [text] ELSE string_split(text, v) END AS pieces FROM v)
SELECT doc_id, CAST(len(pieces) - 1 AS INTEGER) AS n, CAST(CASE WHEN len(pieces) > 1 THEN length(pieces[1]) ELSE -1 END AS INTEGER) AS first_start,
  CAST(CASE WHEN len(pieces) > 1 THEN length(text) - length(pieces[-1]) ELSE -1 END AS INTEGER) AS last_end FROM p""",
    "hex_token_keys": r"""
WITH v AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '[''"]([0-9a-fA-F]{8,})[''"]', 1)) AS value FROM documents),
c AS (SELECT doc_id, value, ch, count(*) AS n FROM (SELECT doc_id, value, unnest(string_split(value, '')) AS ch FROM v) GROUP BY ALL),
e AS (SELECT doc_id, value, -sum(n / length(value) * log2(n / length(value))) - CASE WHEN regexp_full_match(value, '[0-9]{2,}') THEN 1.2 / log2(length(value)) ELSE 0 END AS entropy FROM c GROUP BY doc_id, value),
k AS (SELECT doc_id, value, entropy, substr(text, 1, strpos(text, value) - 1) AS before FROM e JOIN v USING (doc_id, value) WHERE entropy > 3.0)
SELECT doc_id, value, round(entropy, 6) AS entropy FROM k
WHERE NOT (length(value) IN (32, 40, 64) AND regexp_matches(lower(string_split(before, chr(10))[-1]), 'sha|md5|hash|byte'))
  AND NOT regexp_matches(string_split(before, chr(10))[-1], '(?i)(?:^(?:id|myid|userid)|_id)s?["'']?\s*[:=]\s*["'']?$')
  AND NOT contains('0123456789ABCDEF0123456789ABCDEF', upper(value)) AND NOT contains('0123456789ABCDEFABCDEF0123456789ABCDEF', upper(value))""",
    "token_formats": f"""
WITH digests AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS h_, upper(sha256(text)) AS up_, translate(to_base64(unhex(sha256(text))), '+/=', 'aZ9') AS m_ FROM documents), {_plugin_values(_SHAPES)}
SELECT CAST(split_part(s.doc_id, '/', 1) AS BIGINT) AS doc_id, split_part(s.doc_id, '/', 2) AS format, CAST(count(value) AS INTEGER) AS n_found FROM plugin_source s LEFT JOIN secrets USING (doc_id) GROUP BY ALL""",
    "gibberish_scores": f"""
WITH {_BIGRAMS}, {_WORDS}, every AS (SELECT DISTINCT lower(value) AS value FROM words), {_scores("scored", "SELECT value FROM every")}
SELECT value AS word, round(score, 6) AS score FROM every LEFT JOIN scored USING (value)""",
    "address_classes": f"""
SELECT doc_id, value AS address, NOT {_VALID} AS invalid, {_EXCLUDED} AS excluded, {_DATE} AS date_like FROM (
  SELECT doc_id, [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8][doc_id % 12 + 1] || '.' || (doc_id * 7) % 256 || '.' || (doc_id * 13) % 256 || '.' || (doc_id * 29) % 300 AS value FROM documents)""",
    "version_context": f"""
WITH s AS (SELECT doc_id, text, doc_id * 37 % length(text) AS start, doc_id * 37 % length(text) + 7 AS "end" FROM documents), c AS (SELECT *, {_wrapped('start', '"end"')} AS around FROM s)
SELECT doc_id, md5(around) AS context_md5, CAST(length(around) AS INTEGER) AS n, NOT (contains(lower(around), 'dns') OR contains(lower(around), 'server')) AS version_like,
  md5(substr(text, greatest(start - 50, 0) + 1, "end" + 50 - greatest(start - 50, 0))) AS window_md5 FROM c""",
    "mask_documents": f"""
WITH {_matches('ip', _IP, _DOCS)}, {_matches('mail', _EMAIL, _DOCS)},
f AS (SELECT doc_id, start AS a, "end" AS b, 'IP_ADDRESS' AS kind FROM ip WHERE {_ADDRESS} AND NOT {_EXCLUDED} UNION SELECT doc_id, start, "end", 'EMAIL' FROM mail),
g AS (SELECT d.doc_id, d.text, list({{'a': a, 'b': b, 'kind': kind}} ORDER BY a, b, kind) FILTER (a IS NOT NULL) AS spans FROM documents d LEFT JOIN f USING (doc_id) GROUP BY ALL),
m AS (SELECT doc_id, text, CASE WHEN spans IS NULL THEN NULL ELSE {_MASK} END AS s FROM g),
t AS (SELECT doc_id, CASE WHEN s IS NULL THEN text ELSE s.out || substr(text, s.at + 1) END AS masked FROM m)
SELECT doc_id, md5(masked) AS masked_md5, CAST(length(masked) AS INTEGER) AS n_chars FROM t""",
    "mask_overlaps": f"""
WITH g AS (SELECT doc_id, text, CAST(doc_id % 5 AS INTEGER) AS i FROM documents),
p AS (SELECT doc_id, text, i, unnest([{{'n': 1, 'a': 7 - i, 'b': 12 - i, 'kind': 'NAME'}}, {{'n': 2, 'a': 9, 'b': 10, 'kind': 'KEY'}}, {{'n': 3, 'a': 10, 'b': 17 + i, 'kind': 'PASSWORD'}}, {{'n': 4, 'a': 7 - i, 'b': 12 - i, 'kind': 'EMAIL'}}, {{'n': 5, 'a': 30, 'b': 33, 'kind': 'NAME'}}, {{'n': 6, 'a': 33, 'b': 36, 'kind': 'IP_ADDRESS'}}]) AS x FROM g),
o AS (SELECT doc_id, text, list({{'a': x.a, 'b': x.b, 'kind': x.kind}} ORDER BY x.a, x.n) AS spans FROM p GROUP BY doc_id, text),
m AS (SELECT doc_id, text, {_MASK} AS s FROM o)
SELECT doc_id, s.out || substr(text, s.at + 1) AS masked FROM m""",
    "merge_dedupe": f"WITH {_BRANCHES} SELECT * FROM merged",
    "sorted_findings": f'WITH {_BRANCHES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", tag) - 1 AS INTEGER) AS pos, tag, start, "end", value FROM merged',
    "diff_additions": r"""
WITH l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
k AS (SELECT doc_id, i * 2 + 1 AS pos, ['+', '+', '-', ' '][i % 4 + 1] AS sign, line FROM l UNION ALL SELECT doc_id, i * 2, '@', '' FROM l WHERE i % 7 = 6),
r AS (SELECT *, sum(CASE WHEN sign = '+' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM k),
g AS (SELECT doc_id, run, string_agg(line, chr(10) ORDER BY pos) AS text FROM r WHERE sign = '+' GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS filename, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS segment_no, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM g""",
    "token_windows": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS words FROM documents),
o AS (SELECT doc_id, words, unnest(range(0, len(words), 48)) AS off FROM w)
SELECT doc_id, CAST(off AS INTEGER) AS "offset", CAST(len(words[off + 1:off + 64]) AS INTEGER) AS n, md5(array_to_string(words[off + 1:off + 64], ' ')) AS window_md5 FROM o""",
    "combine_windows": f"WITH {_COMBINED} SELECT doc_id, pos, label_no, round(p, 9) AS p FROM combined",
    "best_labels": f"WITH {_COMBINED} SELECT doc_id, pos, ['O', 'B-NAME', 'I-NAME'][label_no + 1] AS label, round(p, 9) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY p DESC, label_no) AS n FROM combined) WHERE n = 1",
    "bio_entities": f"""
WITH {_WORDS},
t AS (SELECT doc_id, pos, ['O', 'B-NAME', 'I-NAME', 'E-NAME', 'S-KEY', 'B-KEY', 'I-KEY', '.'][(doc_id * 31 + CAST(pos AS BIGINT) * pos * 7 + length(value)) % 8 + 1] AS label, CAST(pos + 1 AS DOUBLE) AS p FROM words),
s AS (SELECT doc_id, pos, p, label[1:1] AS prefix, CASE WHEN label IN ('O', '.') THEN '_' ELSE label[3:] END AS type FROM t),
q AS (SELECT *, lag(prefix, 1, 'O') OVER w AS before, lag(type) OVER w AS type_before FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum(CASE WHEN prefix IN ('B', 'S') OR before IN ('O', '.', 'E', 'S') OR type <> type_before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM q WHERE prefix NOT IN ('O', '.'))
SELECT doc_id, type, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, round(avg(p), 9) AS score FROM r GROUP BY doc_id, run, type""",
    "entity_trim": f"""
WITH l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
o AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN (doc_id + pos) % 2 = 0 THEN 'KEY' ELSE 'NAME' END AS tag, '"(_' || line || '), ' AS old FROM l),
c AS (SELECT *, {_CUT} AS cut FROM o), v AS (SELECT *, {_TRIMMED} AS value FROM c)
SELECT doc_id, pos, tag, value, CAST(greatest(strpos(old, value) - 1, 0) AS INTEGER) AS moved FROM v""",
    "entity_filters": f"""
WITH {_WORDS}, {_BIGRAMS},
t AS (SELECT doc_id, pos, value AS word, ['AMBIGUOUS', 'USERNAME', 'IP_ADDRESS', 'NAME', 'PASSWORD', 'EMAIL', 'KEY'][pos % 7 + 1] AS tag FROM words),
r AS (SELECT doc_id, pos, tag, CASE WHEN tag = 'IP_ADDRESS' THEN '81.2.69.' || (doc_id + pos) % 300 WHEN tag = 'KEY' THEN word || substr(md5(word), 1, CAST(doc_id % 20 AS INTEGER)) WHEN pos % 2 = 0 THEN word || ' x' ELSE word END AS value FROM t),
{_scores("r_scores", "SELECT value FROM r WHERE tag = 'KEY'")}
SELECT doc_id, pos, tag, CASE WHEN tag IN ('AMBIGUOUS', 'USERNAME') OR length(value) <= 3 THEN FALSE WHEN tag = 'IP_ADDRESS' THEN NOT {_EXCLUDED}
  WHEN tag = 'KEY' THEN length(value) > 8 AND coalesce(score > 3.0, FALSE) WHEN tag = 'NAME' THEN {_WORDS_IN_VALUE} > 1 ELSE TRUE END AS kept FROM r LEFT JOIN r_scores USING (value)""",
    "ip_v6_spans": f"""
WITH s AS (SELECT doc_id, md5(text) AS h, [doc_id * k % 260 for k in [7, 11, 13, 17]] AS v, ['2a00', '2001:db8', 'fe80', '2001:1', 'fd00', '2002', '64:ff9b:1', '2001:4:112'][doc_id % 8 + 1] AS start FROM documents),
g AS (SELECT doc_id, start, [substr(h, 4 * k + 1, 4) for k in range(0, 8)] AS g, array_to_string([CAST(x AS VARCHAR) for x in v], '.') AS v4 FROM s),
forms AS (SELECT doc_id, [array_to_string(g, ':'), start || '::' || g[2], start || ':' || g[3] || '::', '::ffff:' || v4, '::' || g[4] || ':' || g[5], start || '::' || v4, 'fe80::' || g[6] || '%eth0', g[2] || '::' || g[3] || '::' || g[4], '::1'] AS f FROM g),
{_matches("ip", _IP, "SELECT doc_id, 'at ' || f[doc_id % 9 + 1] || ' and ' || f[1] || ', server ' || f[doc_id // 9 % 9 + 1] || ' now' AS text FROM forms")}, {_KINDS}
SELECT doc_id, start, "end", value, kind <> 'public' OR value IN ({', '.join(map(_quoted, DNS_SERVERS))}) AS excluded FROM ip JOIN kinds USING (value) WHERE regexp_matches(value, '\\d') AND NOT {_DATE} AND NOT {_VERSION} AND kind <> 'invalid'""",
    "plugin_keys": f"WITH {_secret_spans(3.0)} SELECT {_SPAN} FROM secret_spans",
    "model_branch": f"WITH {_BIGRAMS}, {_MODEL_BRANCH} SELECT doc_id, tag, value, start, \"end\", CAST(0.75 AS DOUBLE) AS score FROM entities",
    "scan_default": f'{_SCANNED} SELECT doc_id, filename, start, "end", type, text FROM found',
    "mask_default": f"""{_SCANNED},
g AS (SELECT d.doc_id, d.text, list({{'a': start, 'b': "end", 'kind': type}} ORDER BY start, "end", type) FILTER (start IS NOT NULL) AS spans FROM documents d LEFT JOIN found USING (doc_id) GROUP BY ALL),
m AS (SELECT doc_id, text, CASE WHEN spans IS NULL THEN NULL ELSE {_MASK} END AS s FROM g),
t AS (SELECT doc_id, CASE WHEN s IS NULL THEN text ELSE s.out || substr(text, s.at + 1) END AS masked FROM m)
SELECT doc_id, md5(masked) AS masked_md5, CAST(length(masked) AS INTEGER) AS n_chars FROM t""",
    "scan_with_model": f"""{_DEFAULT}, {_MODEL_BRANCH},
{_findings(*_DEFAULT_BRANCHES, 'SELECT doc_id, start, "end", tag, value FROM entities')}
SELECT doc_id, filename, start, "end", type, text FROM found""",
    "detect_exit": f"{_SCANNED} SELECT CAST(least(count(*), 1) AS INTEGER) AS exit_code FROM found",
    "scan_pipeline": f'{_FOUND} SELECT doc_id, filename, start, "end", type, text FROM found',
    "detect_verdict": f"{_FOUND} SELECT count(*) AS n_findings, CAST(least(count(*), 1) AS INTEGER) AS exit_code FROM found",
    "triage": f'{_FOUND} SELECT doc_id, start, "end", type FROM found WHERE (doc_id + start) % 2 = 1',
    "report_lines": f"{_FOUND} SELECT doc_id, start, filename || ': ' || type || ': ' || replace(text, chr(10), '\\n') AS line FROM found",
    "findings_by_type": f"{_FOUND} SELECT type, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY type",
    "file_suffixes": """
WITH n AS (SELECT doc_id, source || '/' || translate(substr(text, 1, 60), chr(10), '/') || ['.py', '.tar.gz', '', '.', '/.bashrc', '/a.b/c', '/.x.y', '.JSON'][doc_id % 8 + 1] AS name FROM documents),
l AS (SELECT doc_id, string_split(name, '/')[-1] AS last FROM n), p AS (SELECT doc_id, last, string_split(last, '.') AS parts FROM l)
SELECT doc_id, CASE WHEN len(parts) < 2 OR parts[-1] = '' OR replace(array_to_string(parts[1:len(parts) - 1], ''), '.', '') = '' THEN '' ELSE '.' || parts[-1] END AS suffix FROM p""",
    "blank_filter": r"""
WITH b AS (SELECT doc_id, ['', ' ' || chr(9) || chr(13), chr(28) || chr(31), chr(8195) || chr(160), ' x ', chr(8203)][doc_id % 6 + 1] || chr(10) || text || chr(10) AS text FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM b))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, FALSE AS blank FROM l WHERE regexp_replace(line, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') <> ''""",
    "newline_modes": "SELECT doc_id, CAST(length(text) + (length(text) - length(replace(text, chr(10), ''))) + 3 AS INTEGER) AS n_raw, CAST(length(text) + 2 AS INTEGER) AS n_normal, md5(text || chr(10) || chr(10)) AS normal_md5 FROM documents",
}

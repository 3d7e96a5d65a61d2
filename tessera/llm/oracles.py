"""DuckDB SQL for the registered queries that SQL can express.

Packing (a linear program), language identification (a trained network), N-best
segmentation (a search over a model file) and the pipeline, which starts with
language identification, have none; tests/llm compares them with brute-force
versions (for the network, a forward pass position by position).
"""

from __future__ import annotations

from . import chat, line_dedup, quality, url_filter
from .common import SPACE, WORD

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"

_EXACT = rf"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)"""

_SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i : i + 34], ' '))) AS x, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g WHERE n > 1),
gl AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gl USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS x FROM w WHERE len(w) >= 4
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(r.m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)


def _judged(table: str, key: str) -> str:
    """(key, rule, verdict) by the longest fitting rule."""
    return f"""SELECT {key}, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
  FROM {table}, (VALUES {_RULES}) r(rv, rh, rp) WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY {key}"""


def _parts(url: str) -> str:
    rest = f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    return f"""coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{url_filter._UPPER}', '{url_filter._LOWER}'), '') AS host,
  coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) AS target"""


_URL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, {_parts("url")} FROM pages),
tag AS (SELECT url, host, target, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS t FROM u WHERE position('://' IN url) > 0),
far AS (SELECT host || target AS a, replace(CASE WHEN regexp_matches(t, '(?is)^<link.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  WHEN regexp_matches(t, '(?is)^<meta.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(t, '(?is)\\bcontent\\s*=\\s*["'']?\\s*\\d*\\s*[;,]\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1) END, '&amp;', '&') AS to_url FROM tag),
link AS (SELECT DISTINCT a, host || target AS b FROM (SELECT a, {_parts("to_url")} FROM far WHERE regexp_matches(to_url, '(?i)^https?://'))),
ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
node AS (SELECT DISTINCT b AS node, regexp_extract(b, '^([^/?#]*)', 1) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
bad AS (SELECT DISTINCT a FROM reach WHERE b IN (SELECT node FROM ({_judged("node", "node")}) WHERE verdict = 'block')),
own AS ({_judged("u", "page_id")})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN own USING (page_id) LEFT JOIN bad ON bad.a = host || target"""


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat._OPEN) + len(chat._END) + 2} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_LINES = f"""
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS mark, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, mark, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM l WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, {line_dedup._DIGITS}) AS BIGINT) AS h FROM e),
b AS (SELECT *, i = n - 1 OR (h + 31 * coalesce(lag(h, 1) OVER d, 0) + 961 * coalesce(lag(h, 2) OVER d, 0)) % 1000003 % 4 = 0 AS cut FROM h WINDOW d AS (PARTITION BY doc_id, mark ORDER BY i)),
k AS (SELECT *, coalesce(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY doc_id, mark ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM b),
c AS (SELECT doc_id, mark, no, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS body FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, mark, no) AS place FROM c WHERE m > 1 AND regexp_matches(body, '{WORD}')),
g AS (SELECT doc_id, mark, no, m FROM r WHERE place > 1),
t AS (SELECT c.doc_id, c.mark, string_agg(body, chr(10) ORDER BY c.no) AS kept FROM c ANTI JOIN g USING (doc_id, mark, no) GROUP BY ALL),
s AS (SELECT doc_id, mark, sum(m) AS m, string_agg(CAST(CAST(no AS BIGINT) AS VARCHAR), ',' ORDER BY no) AS gone FROM g GROUP BY ALL)
SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(s.m, 0) AS BIGINT) AS n_removed, coalesce(s.gone, '') AS removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM l LEFT JOIN s USING (doc_id, mark) LEFT JOIN t USING (doc_id, mark)"""

_COUNTS = [*[f"len(regexp_extract_all(text, '{p}'))" for k, p in quality.CLASSES.items() if k != "blank"]]
_MARKS = quality.MARKS.replace("'", "''")
_QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
t AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS x, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  [{", ".join(_COUNTS)}] AS k FROM d LEFT JOIN r USING (doc_id)),
h AS (SELECT *, list_concat(k, [n_chars - word_chars, word_chars - list_sum(k)]) AS ch FROM m),
u AS (SELECT doc_id, lang, x, count(*) AS n FROM (SELECT doc_id, lang, trim(lower(unnest(w)), '{_MARKS}') AS x FROM d) GROUP BY ALL),
lw AS (SELECT lang, x, sum(n) AS n FROM u WHERE lang IS NOT NULL GROUP BY ALL),
lt AS (SELECT lang, total FROM (SELECT lang, sum(n) AS total FROM lw GROUP BY lang) QUALIFY total * {quality._SHARE} >= sum(total) OVER ()),
lv AS (SELECT lang, x, n, total FROM lw JOIN lt USING (lang) WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {quality.N_COMMON}),
pw AS (SELECT h.doc_id, lv.lang, lv.x, lv.n, lv.total, h.n_words, coalesce(u.n, 0) AS c FROM h JOIN lv ON h.n_words > 0 LEFT JOIN (SELECT doc_id, x, sum(n) AS n FROM u GROUP BY ALL) u ON u.doc_id = h.doc_id AND u.x = lv.x),
v AS (SELECT doc_id, lang, unnest(ch) AS x, unnest(range(len(ch))) AS b FROM h),
q AS (SELECT lang, b, CAST(sum(x) AS DOUBLE) / sum(sum(x)) OVER (PARTITION BY lang) AS q FROM v WHERE lang IN (SELECT lang FROM lt) GROUP BY lang, b),
p AS (SELECT doc_id, b, CAST(x AS DOUBLE) / nullif(sum(x) OVER (PARTITION BY doc_id), 0) AS p FROM v),
e AS (SELECT doc_id, q.lang, 'c' AS kind, p, q FROM p JOIN q USING (b) WHERE p IS NOT NULL
  UNION ALL SELECT doc_id, lang, 'w', CAST(c AS DOUBLE) / n_words, CAST(n AS DOUBLE) / total FROM pw
  UNION ALL SELECT doc_id, lang, 'w', CAST(any_value(n_words) - sum(c) AS DOUBLE) / any_value(n_words), CAST(any_value(total) - sum(n) AS DOUBLE) / any_value(total) FROM pw GROUP BY doc_id, lang),
j AS (SELECT doc_id, lang, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x FROM e GROUP BY ALL),
z AS (SELECT doc_id, min(x) AS distance FROM (SELECT doc_id, lang, max(x) AS x FROM j GROUP BY ALL) GROUP BY doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words >= 100 AND (lang IS NULL OR lang IN (SELECT lang FROM lt)) AS judged FROM h LEFT JOIN z USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (NOT judged OR distance IS NULL OR distance <= 0.3) AS kept FROM f"""

_HARD = """
WITH v AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3"""

_SUFFIX = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(h) AS z FROM documents),
w AS (SELECT doc_id, unnest(range(z - 99)) AS i, unnest(list_transform(range(z - 99), lambda i: h[i + 1 : i + 100])) AS x FROM d WHERE z >= 100),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS gone FROM w),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS i FROM g WHERE gone)),
c AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM c),
t AS (SELECT k.doc_id, sum(b - a) AS n, count(*) AS m, string_agg(hex(h[k.z + 1 : a]), '' ORDER BY a) || hex(any_value(h)[max(b) + 1 :]) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, z AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(m, 0) AS n_spans, sha256(coalesce(from_hex(kept), h)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

_PHRASES = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM d),
m AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS m FROM w),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS x FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM m WHERE len(w) >= m)),
f AS (SELECT lang, m, x, count(*) AS a, string_split(x, ' ') AS p FROM g GROUP BY lang, m, x HAVING m = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
s AS (SELECT lang, a, p, m, unnest(range(2, m)) AS k FROM f WHERE m > 2),
b AS (SELECT lang, array_to_string(p[i : i + k - 1], ' ') AS x, max(a) AS longer FROM (SELECT lang, a, p, k, unnest(range(1, m - k + 2)) AS i FROM s) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN b USING (lang, x) WHERE m > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
e AS (SELECT lang, x, a, p, unnest(range(1, m)) AS k FROM c),
q AS (SELECT e.lang, e.x, e.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * e.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM e JOIN f l ON l.lang = e.lang AND l.x = array_to_string(e.p[1 : k], ' ') JOIN f r ON r.lang = e.lang AND r.x = array_to_string(e.p[k + 1 :], ' ') JOIN n ON n.lang = e.lang),
z AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(x)) AS rank, x AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM z QUALIFY rank <= 2000"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": _EXACT,
    "op4_substring_dedup": _SUBSTRING,
    "op5_near_dedup": _NEAR,
    "op6_url_filter": _URL,
    "op7_chat": _CHAT,
    "op8_line_dedup": _LINES,
    "op9_quality": _QUALITY,
    "op11_hard_negatives": _HARD,
    "op12_suffix_dedup": _SUFFIX,
    "op13_collocations": _PHRASES,
}

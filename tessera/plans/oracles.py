"""DuckDB SQL that gives the registered queries' rows."""

from __future__ import annotations

from ..functions.text import _BLANK, _ENTITIES, fold_tables, token_class
from ..operators import retrieval as R
from . import corpus_view, queries


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tokens(column: str) -> str:
    source, target, _ = fold_tables()
    return f"regexp_extract_all(translate({column}, {_text(source)}, {_text(target)}), {_text(token_class())})"


def _collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, {_text(_BLANK)}, ' ', 'g'))"


_EXT = "[" + ", ".join(map(_text, corpus_view.EXTENSIONS)) + f"][1 + doc_id % {len(corpus_view.EXTENSIONS)}]"
_RELPATH = f"source || '/' || (2015 + doc_id % 12) || '/' || lang || '-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || CASE WHEN {_EXT} = '' THEN '' ELSE '.' || {_EXT} END"


def _corpus(docs: str = "documents", prefix: str = "") -> str:
    """CTEs ``files`` and ``content``."""
    return f"""{prefix}base AS (
  SELECT {_RELPATH} AS relpath, text, {_EXT} AS ext, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
         source AS area, CAST(2015 + doc_id % 12 AS INTEGER) AS path_year, 1700000000 + doc_id AS mtime, lang,
         lpad(CAST(doc_id AS VARCHAR), 6, '0') AS num, {_collapse("text")} AS body FROM {docs}),
{prefix}stat AS (
  SELECT *, regexp_extract(relpath, '[^/]*$') AS filename,
    CASE WHEN relpath LIKE 'src1/%' THEN 'metadata_only' WHEN ext = 'doc' THEN 'unsupported_format'
         WHEN ext IN ('bin', '') THEN 'no_text_type' WHEN octet_length(encode(body)) > 512000 THEN 'too_big'
         WHEN ext = 'pdf' AND body = '' THEN 'empty_pdf' ELSE 'extracted' END AS content_status FROM {prefix}base),
{prefix}files AS (
  SELECT relpath, relpath AS relpath_nfc, filename, filename AS filename_nfc, area, ext, size_bytes, mtime, path_year, content_status,
    CASE WHEN content_status IN ('metadata_only', 'unsupported_format', 'no_text_type') THEN NULL ELSE sha256(text) END AS source_hash,
    '{{"lang": "' || lang || '", "num": "' || num || '"}}' AS name_meta,
    CAST(content_status = 'metadata_only' AS INTEGER) AS metadata_only,
    CAST(content_status = 'extracted' AND body <> '' AS INTEGER) AS content_present FROM {prefix}stat),
{prefix}content AS (
  SELECT relpath, body AS text, sha256(text) AS source_sig,
    CASE WHEN ext IN ('txt', 'md', 'csv') THEN 'text' WHEN ext = 'html' THEN 'html' WHEN ext = 'pdf' THEN 'pdftotext' END AS extractor
  FROM {prefix}stat WHERE content_status = 'extracted' AND body <> '')"""


def _count(tokens: str, phrase: list[str]) -> str:
    same = " AND ".join(f"{tokens}[i + {k}] = {_text(w)}" for k, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({tokens}) + 1), lambda i: coalesce({same}, false)))"


def _ranks(name: str, table: str, columns: list[str], terms: str) -> str:
    """CTEs that end in ``name``(relpath, score)."""
    query = R.phrases(terms)
    total = " + ".join(f"len({_tokens(c)})" for c in columns)
    arrays = ", ".join(f"{_tokens(c)} AS t{i}" for i, c in enumerate(columns))
    counts = ", ".join("(" + " + ".join(_count(f"t{i}", p) for i in range(len(columns))) + f") AS f{k}" for k, p in enumerate(query))
    n = ", ".join(f"sum(CAST(f{k} > 0 AS INTEGER)) AS n{k}" for k in range(len(query)))
    idf = lambda k: f"CASE WHEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) ELSE {R.LEAST_IDF!r} END"
    score = " + ".join(f"({idf(k)}) * (CAST(f{k} AS DOUBLE) * CAST({R.K1 + 1.0} AS DOUBLE)) / (f{k} + CAST({R.K1} AS DOUBLE) * (CAST({1.0 - R.B} AS DOUBLE) + CAST({R.B} AS DOUBLE) * D / avgdl))" for k in range(len(query)))
    every = " AND ".join(f"f{k} > 0" for k in range(len(query)))
    return f"""{name}_a AS (SELECT relpath, {total} AS D, {arrays} FROM {table}),
{name}_f AS (SELECT relpath, D, {counts} FROM {name}_a),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS N, CAST(sum(D) AS DOUBLE) / count(*) AS avgdl, {n} FROM {name}_f),
{name} AS (SELECT relpath, -({score}) AS score FROM {name}_f, {name}_s WHERE {every})"""


def _tree(name: str, table: str, columns: list[str], phrases: list[tuple], match: str, counts: list[str]) -> str:
    """CTEs that end in ``name``(relpath, score) of a match expression.

    ``phrases`` are (columns, condition on t[i]); ``match`` is the condition on d0, ...,
    and ``counts`` say which occurrences count for the score.
    """
    total = " + ".join(f"len({_tokens(c)})" for c in columns)
    arrays = ", ".join(f"{_tokens(c)} AS t{i}" for i, c in enumerate(columns))
    one = lambda c, p: f"len(list_filter(range(1, len(t{c}) + 1), lambda i: coalesce({p.replace('t[', f't{c}[')}, false)))"
    found = ", ".join("(" + " + ".join(one(c, p) for c in of) + f") AS d{k}" for k, (of, p) in enumerate(phrases))
    n = ", ".join(f"sum(CAST(d{k} > 0 AS INTEGER)) AS n{k}" for k in range(len(phrases)))
    idf = lambda k: f"CASE WHEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((N - n{k} + 0.5) / (n{k} + 0.5)) ELSE {R.LEAST_IDF!r} END"
    score = " + ".join(f"({idf(k)}) * (CAST({c} AS DOUBLE) * CAST({R.K1 + 1.0} AS DOUBLE)) / ({c} + CAST({R.K1} AS DOUBLE) * (CAST({1.0 - R.B} AS DOUBLE) + CAST({R.B} AS DOUBLE) * D / avgdl))" for k, c in enumerate(counts))
    return f"""{name}_a AS (SELECT relpath, {total} AS D, {arrays} FROM {table}),
{name}_f AS (SELECT relpath, D, {found} FROM {name}_a),
{name}_s AS (SELECT CAST(count(*) AS DOUBLE) AS N, CAST(sum(D) AS DOUBLE) / count(*) AS avgdl, {n} FROM {name}_f),
{name} AS (SELECT relpath, -({score}) AS score FROM {name}_f, {name}_s WHERE {match})"""


_ROUND = "round(score * 1000, 9) AS score"
_HIT = "relpath, filename, area, ext, size_bytes, mtime, path_year, metadata_only"


def _search(terms: str, where: str, limit: int) -> str:
    return f"""WITH {_corpus()}, {_ranks("nr", "files", ["filename_nfc", "relpath_nfc"], terms)}, {_ranks("cr", "content", ["text"], terms)},
keep AS (SELECT relpath FROM files WHERE {where}),
n AS (SELECT relpath, row_number() OVER (ORDER BY score, relpath) AS r FROM nr SEMI JOIN keep USING (relpath)),
c AS (SELECT relpath, row_number() OVER (ORDER BY score, relpath) AS r FROM cr SEMI JOIN keep USING (relpath)),
fused AS (SELECT relpath, coalesce(1.0::DOUBLE / (60 + n.r), 0) + coalesce(1.0::DOUBLE / (60 + c.r), 0) AS score,
  CASE WHEN n.r IS NOT NULL AND c.r IS NOT NULL THEN 'both' WHEN n.r IS NOT NULL THEN 'name' ELSE 'content' END AS matched_by
  FROM n FULL JOIN c USING (relpath) ORDER BY score DESC, relpath LIMIT {limit})
SELECT {_HIT}, matched_by, {_ROUND} FROM fused JOIN files USING (relpath)"""


def _html() -> str:
    t = "regexp_replace(html, '<(?:script)\\b[^>]*>.*?</script\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<(?:style)\\b[^>]*>.*?</style\\s*>', ' ', 'gis')"
    t = f"regexp_replace({t}, '<!--.*?-->', ' ', 'gs')"
    t = f"regexp_replace({t}, '<[!/?a-zA-Z][^>]*>', ' ', 'gs')"
    for k, v in _ENTITIES.items():
        t = f"replace({t}, {_text(k)}, {_text(v)})"
    return f"SELECT page_id, {_collapse(t)} AS text FROM pages"


_CHANGED = "(SELECT * REPLACE (CASE WHEN doc_id % 10 = 0 THEN text || ' changed' ELSE text END AS text) FROM documents{})"
_PHRASE = f"WITH {_corpus()}, {_ranks('cr', 'content', ['text'], queries.PHRASE)} SELECT relpath, {_ROUND} FROM cr"
_C = f"WITH {_corpus()} "

_ROWS = f"sum(len({_tokens('filename_nfc')}) + len({_tokens('relpath_nfc')})) AS np"

_GROUP = "d1 > 0 AND d2 > 0 AND NOT d3 > 0"
_BOOLEAN = _tree("m", "content", ["text"], [([0], "starts_with(t[i], 'licen')"), ([0], "t[i] = 'de' AND t[i + 1] = 'la'"), ([0], "t[i] = 'en'"), ([0], "t[i] = 'les'")], f"d0 > 0 OR ({_GROUP})", ["d0", f"(CASE WHEN {_GROUP} THEN d1 ELSE 0 END)", f"(CASE WHEN {_GROUP} THEN d2 ELSE 0 END)", "0"])
_NAMED = _tree("m", "files", ["filename_nfc", "relpath_nfc"], [([0], "starts_with(t[i], 'fr')"), ([0], "starts_with(t[i], 'de')"), ([1], "i = 1 AND t[i] = 'src2'")], "(d0 > 0 OR d1 > 0) AND d2 > 0", ["d0", "d1", "d2"])
_RANKED = _tree("m", "content", ["text"], [([0], "starts_with(t[i], 'licen')"), ([0], "t[i] = 'the' AND t[i + 1] = 'of'")], "d0 > 0 OR d1 > 0", ["d0", "d1"])

ORACLES: dict[str, str] = {
    "match_boolean": f"WITH {_corpus()}, {_BOOLEAN} SELECT relpath, {_ROUND} FROM m",
    "match_names": f"WITH {_corpus()}, {_NAMED} SELECT relpath, {_ROUND} FROM m",
    "match_near": f"{_C}, t AS (SELECT relpath, {_tokens('text')} AS t FROM content) SELECT relpath FROM t WHERE len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'the' AND (coalesce(list_contains(t[i + 1 : i + 3], 'of'), false) OR coalesce(list_contains(t[greatest(i - 3, 1) : i - 1], 'of'), false)))) > 0",
    "sql_match_rank": f"WITH {_corpus()}, {_RANKED} SELECT area, relpath, round(score * 1000, 9) AS score FROM m JOIN files USING (relpath) WHERE ext <> 'md' ORDER BY m.score, relpath LIMIT 40",
    "index_build": f"{_C}, n AS (SELECT count(*) AS f, {_ROWS} FROM files), c AS (SELECT count(*) AS c, CAST(coalesce(sum(len({_tokens('text')})), 0) AS BIGINT) AS cp FROM content) SELECT unnest(['files', 'names_lengths', 'names_postings', 'content', 'content_lengths', 'content_postings']) AS name, unnest([f, f, CAST(np AS BIGINT), c, c, cp]) AS n_rows FROM n, c",
    "search_rrf": _search(queries.TERMS, "true", 20),
    "search_filtered": _search(queries.COMMON, "area = 'src0' AND ext = 'txt' AND path_year = 2019", 50),
    "name_search": f"WITH {_corpus()}, {_ranks('nr', 'files', ['filename_nfc', 'relpath_nfc'], 'src3 fr')}, best AS (SELECT * FROM nr ORDER BY score, relpath LIMIT 30) SELECT {_HIT}, 'name' AS matched_by, {_ROUND} FROM best JOIN files USING (relpath)",
    "content_ranks": f"WITH {_corpus()}, {_ranks('cr', 'content', ['text'], queries.COMMON)}, best AS (SELECT cr.* FROM cr JOIN files USING (relpath) WHERE area = 'src0' ORDER BY score, relpath LIMIT 100) SELECT relpath, {_ROUND} FROM best",
    "phrase_search": _PHRASE,
    "index_lookup": _PHRASE,
    "bm25_scores": f"WITH {_corpus()}, {_ranks('cr', 'content', ['text'], queries.COMMON)} SELECT relpath, {_ROUND} FROM cr",
    "term_stats": f"{_C}, t AS (SELECT relpath, unnest({_tokens('text')}) AS term FROM content) SELECT term, count(DISTINCT relpath) AS n_docs, count(*) AS n_total FROM t GROUP BY term",
    "token_stats": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, list_max(t) AS last_token FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "derive_paths": f"{_C} SELECT relpath, filename, area, ext, path_year, CASE WHEN ext IN ('txt', 'md', 'csv') THEN 'text' WHEN ext = 'html' THEN 'html' WHEN ext = 'pdf' THEN 'pdftotext' END AS extractor FROM files",
    "name_meta": f"{_C} SELECT relpath, name_meta FROM files",
    "metadata_only_globs": f"{_C} SELECT relpath FROM files WHERE relpath LIKE 'src1/%' OR relpath LIKE '%.md'",
    "access_roots": f"{_C} SELECT relpath FROM files WHERE relpath LIKE 'src1/%' OR relpath LIKE 'src2/2020/%'",
    "prune_leaks": f"{_C} SELECT name, sum(CAST('/' || relpath LIKE '%/' || name || '/%' AS BIGINT))::BIGINT AS n_leaked FROM files, (VALUES ('2019'), ('2024')) v(name) GROUP BY name",
    "status_breakdown": f"{_C} SELECT content_status, count(*) AS n_files FROM files GROUP BY content_status",
    "breakdown_json": f"{_C}, s AS (SELECT content_status, count(*) AS n FROM files GROUP BY content_status) SELECT '{{' || string_agg('\"' || content_status || '\":' || n, ',' ORDER BY content_status) || '}}' AS breakdown FROM s",
    "extracted_bytes": f"{_C} SELECT CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS extracted_bytes FROM content",
    "content_hash": f"{_C} SELECT relpath, source_hash, size_bytes FROM files",
    "html_extract": _html(),
    "collapse_ws": f"SELECT doc_id, sha256({_collapse('text')}) AS text_sha256 FROM documents",
    "cache_reuse": f"WITH {_corpus()}, {_corpus(_CHANGED.format(''), 'new_')} SELECT m.relpath, f.relpath IS NOT NULL AS hit, f.content_status AS old_status, CAST(octet_length(encode(c.text)) AS BIGINT) AS text_bytes FROM (SELECT relpath, source_hash FROM new_files WHERE source_hash IS NOT NULL) m LEFT JOIN (SELECT * FROM files WHERE content_status IN ('extracted', 'empty_pdf', 'too_big')) f ON m.relpath = f.relpath AND m.source_hash = f.source_hash LEFT JOIN content c ON c.relpath = f.relpath",
    "manifest_diff": f"WITH {_corpus('(SELECT * FROM documents WHERE doc_id % 7 <> 0)')}, {_corpus(_CHANGED.format(' WHERE doc_id % 11 <> 0'), 'new_')}, d AS (SELECT coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN a.relpath IS NULL THEN 'added' WHEN b.relpath IS NULL THEN 'removed' WHEN a.size_bytes <> b.size_bytes OR a.source_hash IS DISTINCT FROM b.source_hash THEN 'changed' END AS change FROM files a FULL JOIN new_files b ON a.relpath = b.relpath) SELECT * FROM d WHERE change IS NOT NULL",
    "fk_violations": f"{_C} SELECT relpath, extractor FROM content ANTI JOIN (SELECT relpath FROM files WHERE area <> 'src2') USING (relpath)",
    "drop_guard": f"{_C}, g AS (SELECT area, count(*) AS n_before, count(*) FILTER (path_year >= 2021) AS n_now FROM files GROUP BY area) SELECT *, n_now < n_before * 0.5 AS refused FROM g",
    "tsv_sanitize": "WITH c AS (SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '=' ELSE '' END || text, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS c FROM documents) SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+@-]') THEN '''' || c ELSE c END AS cell FROM c",
    "sql_json": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "sql_index": f"{_C} SELECT area, ext, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(text) AS with_text FROM files LEFT JOIN content USING (relpath) WHERE path_year >= 2018 GROUP BY area, ext",
} | queries.SQL

"""Registered queries of the index engine; ``oracles`` has the SQL of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import checks
from ..operators import retrieval as R
from ..operators.snippet import snippet
from . import corpus_view, index, search, sqlguard
from .workspace import stored

TERMS, PHRASE, COMMON, MIXED = "license", "the-of", "the of", "src1 license"
ROOTS, PRUNED = ["src1", "src2/2020"], ["2019", "2024"]
GLOBS = ["src1/*", "*.md"]
# Match expressions: a prefix, or a group of which one part must not occur; columns; and a distance.
MATCH_TEXT, MATCH_NAMES, MATCH_NEAR = 'licen* OR ("de la" AND en NOT les)', "filename_nfc : (fr* OR de*) AND relpath_nfc : ^src2", "NEAR(the of, 2)"
SQL_MATCH = "SELECT f.area, t.relpath, round(bm25(content_fts) * 1000, 9) AS score FROM content_fts t JOIN files f ON f.relpath = t.relpath WHERE content_fts MATCH 'licen* OR \"the of\"' AND f.ext <> 'md' ORDER BY bm25(content_fts), t.relpath LIMIT 40"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Floor scores are about 1e-6, so scores are scaled before rounding."""
    return df.withColumn("score", F.round(F.col("score") * 1000, digits))


def index_build(spark, sf_dir):
    """Writes the tables and their indexes anew, which the searches below use; rows of each, of postings one a token."""
    tables = corpus_view.written(spark, sf_dir, again=True)
    names = ["files", "content", *(f"{i}_lengths" for i in search.INDEXES)]
    rows = [tables.table(n).select(F.lit(n).alias("name"), F.lit(1).alias("n")) for n in names]
    rows += [tables.rows(i).select(F.lit(f"{i}_postings").alias("name"), R.occurrences(len(columns)).alias("n")) for i, (_, columns) in search.INDEXES.items()]
    return reduce(DataFrame.unionByName, [r.groupBy("name").agg(F.sum("n").alias("n_rows")) for r in rows])


def search_rrf(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).search(TERMS, limit=20, snippets=False).drop("name_meta"))


def search_filtered(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).search(COMMON, limit=50, snippets=False, area="src0", ext=".TXT", year=2019).drop("name_meta"))


def name_search(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).names("src3 fr", limit=30).drop("name_meta", "snippet"))


def content_ranks(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).ranks("content", R.phrases(COMMON), R.file_filter(area="src0"), 100))


def phrase_search(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).scores("content", R.phrases(PHRASE)))


def bm25_scores(spark, sf_dir):
    """From texts, in a narrow pass, where there is no index."""
    _, content = corpus_view.load(spark, sf_dir)
    query = R.phrases(COMMON)
    scanned = stored(R.scan(content, ["text"], query))
    return _rounded(R.matched(scanned, R.stats(scanned, len(query)), len(query)))


def index_lookup(spark, sf_dir):
    """The same scores as ``phrase_search``, with the postings' statistics made by hand."""
    tables, query = corpus_view.written(spark, sf_dir), R.phrases(PHRASE)
    found, sizes = tables.found("content", query), tables.table("content_lengths")
    n = sizes.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    return _rounded(R.matched(found, R.Stats(n[0], n[1], (found.where("f0 > 0").count(),)), len(query)))


def term_stats(spark, sf_dir):
    """The stored term dictionary of the content index."""
    return corpus_view.written(spark, sf_dir).table("content_terms")


def match_boolean(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).matches("content", MATCH_TEXT))


def match_names(spark, sf_dir):
    return _rounded(corpus_view.written(spark, sf_dir).matches("names", MATCH_NAMES))


def match_near(spark, sf_dir):
    return corpus_view.written(spark, sf_dir).matches("content", MATCH_NEAR).select("relpath")


def sql_match_rank(spark, sf_dir):
    """A match with its scores, joined with files, through the SQL surface."""
    tables = corpus_view.written(spark, sf_dir)
    statement = index.with_full_text(tables, SQL_MATCH)
    return sqlguard.checked(spark, statement.text, {"files": tables.table("files")} | statement.tables, statement.hidden)


def token_stats(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_max("t").alias("last_token"))


def derive_paths(spark, sf_dir):
    files, _ = corpus_view.load(spark, sf_dir)
    return files.select("relpath", "filename", "area", "ext", "path_year", paths.extractor(F.col("ext")).alias("extractor"))


def name_meta(spark, sf_dir):
    files, _ = corpus_view.load(spark, sf_dir)
    return files.select("relpath", "name_meta")


def metadata_only_globs(spark, sf_dir):
    files, _ = corpus_view.load(spark, sf_dir)
    return files.where(paths.matches_glob(F.col("relpath_nfc"), GLOBS)).select("relpath")


def access_roots(spark, sf_dir):
    files, _ = corpus_view.load(spark, sf_dir)
    return files.where(paths.authorized(F.col("relpath"), ROOTS)).select("relpath")


def prune_leaks(spark, sf_dir):
    return checks.prune_leaks(corpus_view.load(spark, sf_dir)[0], PRUNED)


def status_breakdown(spark, sf_dir):
    return checks.status_breakdown(corpus_view.load(spark, sf_dir)[0])


def breakdown_json(spark, sf_dir):
    return checks.breakdown_json(corpus_view.load(spark, sf_dir)[0])


def extracted_bytes(spark, sf_dir):
    return checks.extracted_bytes(corpus_view.load(spark, sf_dir)[1])


def content_hash(spark, sf_dir):
    return corpus_view.load(spark, sf_dir)[0].select("relpath", "source_hash", "size_bytes")


def html_extract(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def collapse_ws(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.collapse_blanks(F.col("text")), 256).alias("text_sha256"))


def _changed(docs: DataFrame) -> DataFrame:
    """Every tenth document with another text."""
    return docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))


def cache_reuse(spark, sf_dir):
    """Which files a rebuild takes over after every tenth document changed."""
    docs = _table(spark, sf_dir, "documents")
    old = corpus_view.files_and_content(docs)
    new, _ = corpus_view.files_and_content(_changed(docs))
    return checks.reuse(new.select("relpath", "source_hash").where("source_hash is not null"), *old).select("relpath", "hit", "old_status", F.octet_length("text").cast("long").alias("text_bytes"))


def manifest_diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    before, _ = corpus_view.files_and_content(docs.where("doc_id % 7 <> 0"))
    after, _ = corpus_view.files_and_content(_changed(docs.where("doc_id % 11 <> 0")))
    return checks.manifest_diff(before, after, ["size_bytes", "source_hash"])


def fk_violations(spark, sf_dir):
    files, content = corpus_view.load(spark, sf_dir)
    return checks.orphans(content, files.where("area <> 'src2'")).select("relpath", "extractor")


def drop_guard(spark, sf_dir):
    files, _ = corpus_view.load(spark, sf_dir)
    counts = files.groupBy("area").agg(F.count("*").alias("n_before"), F.count(F.when(F.col("path_year") >= 2021, 1)).alias("n_now"))
    return counts.withColumn("refused", checks.dropped_too_far(F.col("n_now"), F.col("n_before"), 0.5))


def tsv_sanitize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.tsv_cell(F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), "text")).alias("cell"))


def snippets(spark, sf_dir):
    tables, query = corpus_view.written(spark, sf_dir), R.phrases(TERMS)
    top = tables.ranks("content", query, R.file_filter(), 50)
    return tables.table("content").join(F.broadcast(top), "relpath").select("relpath", snippet(F.col("text"), query).alias("snippet"))


# Statements for the bounded SQL surface; DuckDB runs the same text.
SQL = {
    "sql_select": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 200",
    "sql_join_inner": "SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY n_name",
    "sql_join_left": "SELECT c_mktsegment, count(*) AS n_rows, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "sql_join_full": "SELECT s_nationkey, n_nationkey, count(*) AS n FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey GROUP BY s_nationkey, n_nationkey",
    "sql_semi_anti": "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "sql_aggregate": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_quantity) AS least, max(l_quantity) AS most, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "sql_grouping_sets": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())",
    "sql_window": "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS step FROM customer",
    "sql_setops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier UNION SELECT n_regionkey AS k FROM nation EXCEPT SELECT 3 AS k",
    "sql_recursive": "WITH RECURSIVE y AS (SELECT date_trunc('year', o_orderdate) AS year, count(*) AS n_orders FROM orders GROUP BY 1), p AS (SELECT row_number() OVER (ORDER BY year) AS k, n_orders FROM y), t(k, total) AS (SELECT CAST(1 AS BIGINT), CAST(n_orders AS BIGINT) FROM p WHERE k = 1 UNION ALL SELECT p.k, total + p.n_orders FROM t JOIN p ON p.k = t.k + 1) SELECT CAST(k AS BIGINT) AS k, total FROM t",
    "sql_subquery": "SELECT p_brand, round(avg(p_retailprice), 4) AS mean_price FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) GROUP BY p_brand",
    "sql_case": "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _sql_query(statement: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sqlguard.checked(spark, statement, {n: _table(spark, sf_dir, n) for n in _TABLES})

    return run


def sql_json(spark, sf_dir):
    return sqlguard.checked(spark, "SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2", {"events": _table(spark, sf_dir, "events")})


def sql_index(spark, sf_dir):
    """SQL over the index tables themselves."""
    files, content = corpus_view.load(spark, sf_dir)
    return sqlguard.checked(spark, "SELECT area, ext, count(*) AS n, sum(size_bytes) AS bytes, count(text) AS with_text FROM files LEFT JOIN content USING (relpath) WHERE path_year >= 2018 GROUP BY area, ext", {"files": files, "content": content})


QUERIES = {f.__name__: f for f in (index_build, search_rrf, search_filtered, name_search, content_ranks, phrase_search, bm25_scores, index_lookup, term_stats, match_boolean, match_names, match_near, sql_match_rank, token_stats, derive_paths, name_meta, metadata_only_globs, access_roots, prune_leaks, status_breakdown, breakdown_json, extracted_bytes, content_hash, html_extract, collapse_ws, cache_reuse, manifest_diff, fk_violations, drop_guard, tsv_sanitize, snippets, sql_json, sql_index)} | {k: _sql_query(v) for k, v in SQL.items()}

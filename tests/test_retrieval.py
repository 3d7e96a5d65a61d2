import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.operators import retrieval as R
from tessera.plans import corpus_view, search
from tessera.operators.snippet import snippet_of

DOCS = [("a/x.txt", "the red fox. The red hen ran; foo-bar"), ("b/y.txt", "foo bar foo-bar red"), ("c/red.txt", "hen and fox"), ("d/z.txt", ""), ("e/w.md", "the " * 30 + "red hen: sat. " + "the end " * 20)]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?)", DOCS)
    return con


@pytest.mark.parametrize("terms", ["red", "the", "foo-bar", "red hen", "red-hen fox", "the the", "-- red", "x txt", "nothing", "c-red"])
def test_scores_are_those_of_fts5(spark, fts, terms):
    match = " ".join('"' + t.replace('"', '""') + '"' for t in terms.split())
    want = {n: s for n, s in fts.execute("SELECT name, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    docs = spark.createDataFrame(DOCS, "relpath string, text string")
    query = R.phrases(terms)
    for found in (R.scan(docs, ["relpath", "text"], query), R.lookup(R.postings(docs, ["relpath", "text"]), R.lengths(docs, ["relpath", "text"]), query)):
        n = R.lengths(docs, ["relpath", "text"]).agg(F.count("*"), F.sum("n_tokens")).first()
        s = R.Stats(n[0], n[1], R.stats(found, len(query)).with_phrase)
        got = {r.relpath: r.score for r in R.matched(found, s, len(query)).collect()}
        assert got == pytest.approx(want)


def test_snippets_are_those_of_fts5(fts):
    for terms in ("red", "hen fox", "foo-bar", "the", "end red"):
        match = " ".join(f'"{t}"' for t in terms.split())
        rows = fts.execute("SELECT text, snippet(t, 1, '[', ']', ' … ', 12) FROM t WHERE t MATCH ?", (f"text : ({match})" if " " not in match else f"text : ({match.replace(' ', ' AND ')})",)).fetchall()
        for text, want in rows:
            assert snippet_of(text, R.phrases(terms)) == want


def test_fusion(spark):
    names = spark.createDataFrame([("b-name", -100.0), ("z-both", -0.1)], "relpath string, score double")
    texts = spark.createDataFrame([("a-content", -50.0), ("z-both", -0.2)], "relpath string, score double")
    got = [tuple(r) for r in R.fuse(names, texts, 3).select("relpath", "matched_by", "score").collect()]
    assert got == [("z-both", "both", 1 / 62 + 1 / 62), ("a-content", "content", 1 / 61), ("b-name", "name", 1 / 61)]


def test_limits(spark):
    with pytest.raises(R.QueryError):
        R.phrases("  ")
    with pytest.raises(R.QueryError):
        R.check_candidates(spark.range(11), most=10)
    assert R.phrases("-- foo-bar") == [["foo", "bar"]]


def test_reuse_and_diff(spark):
    files = spark.createDataFrame([("a", "h1", "extracted", 1), ("b", "h2", "error", 0), ("c", "h3", "extracted", 1), ("d", "h4", "extracted", 0)], "relpath string, source_hash string, content_status string, content_present int")
    content = spark.createDataFrame([("a", "text a", "text", "h1"), ("c", "text c", "text", "other")], "relpath string, text string, extractor string, source_sig string")
    now = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", "h4"), ("e", "h1")], "relpath string, source_hash string")
    got = {r.relpath: (r.hit, r.broken) for r in checks.reuse(now, files, content).collect()}
    assert got == {"a": (True, False), "b": (False, None), "c": (True, True), "d": (True, False), "e": (False, None)}
    diff = {(r.relpath, r.change) for r in checks.manifest_diff(files, now.where("relpath <> 'a'").withColumn("source_hash", F.when(F.col("relpath") == "c", "new").otherwise(F.col("source_hash"))), ["source_hash"]).collect()}
    assert diff == {("a", "removed"), ("c", "changed"), ("e", "added")}


def test_reuse_deals_texts_once(spark):
    """Texts are dealt by path; the hash doesn't make them be dealt again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("a", "h1", "extracted", 1), ("b", "h2", "extracted", 1)], "relpath string, source_hash string, content_status string, content_present int")
        content = spark.createDataFrame([("a", "one", "text", "h1"), ("b", "two", "text", "h2")], "relpath string, text string, extractor string, source_sig string")
        now = spark.createDataFrame([("a", "h1"), ("b", "new"), ("c", "h1"), ("d", None)], "relpath string, source_hash string")
        out = checks.reuse(now, files, content)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted((r.relpath, r.hit, r.text) for r in out.collect()) == [("a", True, "one"), ("b", False, None), ("c", False, None), ("d", False, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reading_files_collapses_no_text_for_hashes(spark):
    """Each text is looked at once: hashes don't wait for it to be collapsed, nor do unread files."""
    docs = spark.createDataFrame([(1, " a  b ", "en", "src0"), (2, "x", "en", "src1"), (6, " ", "en", "src0")], "doc_id long, text string, lang string, source string")
    read = corpus_view.read_files(docs)
    assert "regexp_replace" not in read.select("relpath", "source_hash")._jdf.queryExecution().optimizedPlan().toString()
    assert read._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert {r.relpath: r.body for r in read.collect()} == {"src0/2016/en-000001.md": "a b", "src1/2017/en-000002.csv": None, "src0/2021/en-000006.pdf": None}


def test_lookup_deals_hits_once(spark):
    """By document, which serves the count of beginnings and that of phrases."""
    docs = spark.createDataFrame(DOCS, "relpath string, text string")
    found = R.lookup(R.exploded(R.tokenised(docs, ["text"]), 1), None, R.phrases("red foo-bar"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.relpath: (r.n_tokens, r.f0, r.f1) for r in found.collect() if r.f0 and r.f1} == {"a/x.txt": (9, 2, 1), "b/y.txt": (5, 1, 2)}


@pytest.mark.parametrize("terms", ["red", "the", "foo-bar red", "the-the", "red-hen fox", "x-txt the-red", "nothing red", "nothing-red", "red red-hen-sat"])
def test_lookup_in_rows_deals_words_of_documents_not_occurrences(spark, terms):
    docs, columns, query = spark.createDataFrame(DOCS, "relpath string, text string"), ["relpath", "text"], R.phrases(terms)
    found = R.lookup_rows(R.indexed(docs, columns), 2, query)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    want = {tuple(r) for r in R.lookup(R.exploded(R.tokenised(docs, columns), 2), None, query).collect()}
    assert {tuple(r) for r in found.collect()} == want


def test_indexes_are_written_without_storing_tokens(spark, tmp_path, monkeypatch):
    """Lengths and terms come from the postings; documents without a token have a length too."""
    docs = [*DOCS, ("none.txt", None), ("signs.txt", "-- !"), ("marks.txt", "́ été \U00010400 naïve")]
    rows = spark.createDataFrame([(p, p, p.rpartition("/")[2], t) for p, t in docs], "relpath string, relpath_nfc string, filename_nfc string, text string")
    for name in ("files", "content"):
        rows.write.parquet(f"{tmp_path}/{name}")
    monkeypatch.setattr(search, "stored", None)
    search.write_indexes(spark, str(tmp_path))
    tables = search.Tables(spark, str(tmp_path))
    found = R.tokenised(rows, ["text"])
    assert sorted(map(tuple, tables.postings("content").collect())) == sorted(map(tuple, R.exploded(found, 1).collect()))
    assert sorted(map(tuple, tables.table("content_lengths").collect())) == sorted((r.relpath, r.n_tokens) for r in found.collect())
    assert tables.table("content_terms").where("term IS NULL OR n_docs < 1").count() == 0

"""Match expressions and their functions against SQLite's FTS5."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import match as M
from tessera.operators import retrieval as R
from tessera.plans import index as I
from tessera.plans.search import Tables, write_indexes

COLUMNS = ["name", "text"]
DOCS = [
    ("a/x.txt", "the red fox. The red hen ran; foo-bar"),
    ("b/y.txt", "foo bar foo-bar red reddish"),
    ("c/red.txt", "hen and fox"),
    ("d/z.txt", ""),
    ("e/w.md", "the " * 30 + "red hen: sat. " + "the end " * 20),
    ("f/near.md", "red one two three four five six seven hen fox red hen"),
    ("g/Été.txt", "été red été hen Etude"),
    ("h/fox.md", "fox fox fox red"),
]
EXPRESSIONS = [
    "red", "red hen", "red AND hen", "red OR fox", "red NOT hen", "fox OR hen AND the", "(fox OR hen) AND the", "fox NOT red NOT hen", "red OR fox NOT hen", "a b OR fox red",
    "re*", '"foo ba" *', "foo + ba*", '"red hen"', "red + hen", "^red", "^ the", 'name : red', "{name text} : red", "- name : red", "-{text} : red", 'text : (red OR fox)', "name : fox OR text : hen",
    "NEAR(red hen)", "NEAR(red hen, 0)", "NEAR(red hen, 2)", "NEAR(red fox hen, 7)", 'NEAR("red hen" the, 3) OR foo', "NEAR(the end the, 1)", "hen NEAR(red fox, 5)", "text : NEAR(red hen, 1)", "nothing", "red NOT nothing", "nothing OR red", "-- OR red".replace("--", '"--"'), '"--"', "NOT_A_WORD", "near", "et*", "x txt", "text : ^the red",
]
WRONG = ["red AND", "(red", "red)", "OR red", "nosuch : red", "NEAR(red hen, x)", "NEAR(red", "red ^", "*", "red + ", "{name : red", "- red"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(name, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?)", DOCS)
    return con


@pytest.fixture(scope="module")
def post(spark):
    docs = spark.createDataFrame(DOCS, "name string, text string").withColumn("relpath", F.col("name"))
    found = R.tokenised(docs, COLUMNS)
    return R.exploded(found, 2).persist(), found.agg(F.count("*"), F.sum("n_tokens")).first()


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_matches_and_scores_are_those_of_fts5(post, fts, text):
    want = dict(fts.execute("SELECT name, bm25(t) FROM t WHERE t MATCH ?", (text,)).fetchall())
    node = M.parse(text, COLUMNS)
    if node is None:
        assert want == {}
        return
    counts, n = M.counts(post[0], node), sum(1 for _ in node.phrases())
    hits = counts.agg(*[F.count(F.when(F.col(f"d{k}") > 0, 1)) for k in range(n)]).first()
    found = counts.where(M.condition(node)[0]).select("relpath", "n_tokens", *[c.alias(f"f{k}") for k, c in enumerate(M.counted(node))])
    got = {r.relpath: r.score for r in found.select("relpath", R.bm25(R.Stats(*post[1], tuple(hits)), n).alias("score")).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("text", WRONG)
def test_syntax_errors(fts, text):
    with pytest.raises(sqlite3.OperationalError):
        fts.execute("SELECT name FROM t WHERE t MATCH ?", (text,)).fetchall()
    with pytest.raises(R.QueryError):
        M.parse(text, COLUMNS)


@pytest.mark.parametrize("text", ["red", "re*", "red OR fox", "red NOT foo", "text : hen", "NEAR(red hen, 2)", '"red hen" OR foo'])
@pytest.mark.parametrize("size", [3, 12])
def test_snippets_and_highlights_are_those_of_fts5(fts, text, size):
    node = M.parse(text, COLUMNS)
    for name, body, snippet, marked in fts.execute(f"SELECT name, text, snippet(t, 1, '<', '>', '~', {size}), highlight(t, 1, '<', '>') FROM t WHERE t MATCH ?", (text,)).fetchall():
        assert I.marked_text([name, body], node, 1, ["<", ">", "~"], size) == snippet
        assert I.marked_text([name, body], node, 1, ["<", ">"], 0) == marked


def snapshot(spark, path, docs, previous=None):
    rows = spark.createDataFrame([(p, p, p.rpartition("/")[2], t, str(hash(t))) for p, t in docs], "relpath string, relpath_nfc string, filename_nfc string, text string, source_sig string")
    rows.select("relpath", "relpath_nfc", "filename_nfc").write.parquet(f"{path}/files")
    rows.where("text <> ''").select("relpath", "text", "source_sig").write.parquet(f"{path}/content")
    write_indexes(spark, path, previous)
    return Tables(spark, path)


def contents(tables):
    out = {}
    for i in ("names", "content"):
        out[i] = [sorted(map(tuple, df.collect())) for df in (tables.postings(i), tables.table(f"{i}_terms").select("term", "n_docs", "n_total"), tables.table(f"{i}_lengths").select("relpath", "n_tokens"))]
        out[i].append(tuple(tables.stats(i))[:2])
    return out


def test_segments_hold_what_a_whole_build_holds(spark, tmp_path):
    docs = dict(DOCS) | {f"many/{k}.txt": f"word{k} red" for k in range(60)}
    old = snapshot(spark, f"{tmp_path}/0", docs.items())
    for step, (change, segments) in enumerate([({"a/x.txt": "the hen only"}, 2), ({"b/y.txt": None, "new.txt": "new red words"}, 3), ({f"many/{k}.txt": "again" for k in range(40)}, 1)], 1):
        docs = {p: t for p, t in (docs | change).items() if t is not None}
        now = snapshot(spark, f"{tmp_path}/{step}", docs.items(), old.path)
        assert contents(now) == contents(snapshot(spark, f"{tmp_path}/whole{step}", docs.items()))
        assert len(list((tmp_path / str(step) / "content_postings").glob("segment=*"))) == segments
        if step == 1:  # only the changed file was read again
            last = spark.read.parquet(f"{now.path}/content_postings/segment=1")
            assert [r.relpath for r in last.select("relpath").distinct().collect()] == ["a/x.txt"]
        assert {r.relpath for r in now.matches("content", "again OR new").collect()} == {p for p, t in docs.items() if "again" in t or "new" in t}
        old = now


def test_queries_read_no_lengths_and_no_files(spark, tmp_path):
    tables = snapshot(spark, f"{tmp_path}/0", DOCS)
    plan = tables.ranks("content", R.phrases("red hen"), R.file_filter(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "n_tokens" in plan and "In(term" in plan
    read = tables.ranks("content", R.phrases("red hen"), R.file_filter(), 10).inputFiles()
    assert read and all("content_postings" in f for f in read)


def test_full_text_in_statements(spark, tmp_path):
    tables = snapshot(spark, f"{tmp_path}/0", DOCS)
    made = I.with_full_text(tables, "SELECT t.relpath, bm25(content_fts) AS b, snippet(content_fts, 0, '[', ']', '..', 5) AS s FROM content_fts AS t WHERE content_fts MATCH 'fox NOT hen' AND 'MATCH' <> 'x' ORDER BY bm25(content_fts)")
    got = I.sqlguard.run_sql(spark, made.text, made.tables, 60.0, made.hidden)
    assert [(r["relpath"], r["s"]) for r in got] == [("h/fox.md", "[fox] [fox] [fox] red")] and got[0]["b"] < 0
    made = I.with_full_text(tables, "SELECT relpath FROM files_fts WHERE files_fts MATCH 'red OR near' UNION SELECT relpath FROM content_fts WHERE content_fts MATCH 'reddish'")
    assert {r["relpath"] for r in I.sqlguard.run_sql(spark, made.text, made.tables, 60.0, made.hidden)} == {"c/red.txt", "f/near.md", "b/y.txt"}
    for wrong in ("SELECT bm25(content_fts) FROM content_fts", "SELECT bm25(content_fts, 2.0) FROM content_fts WHERE content_fts MATCH 'x'", "SELECT snippet(content_fts, 7, '', '', '', 5) FROM content_fts WHERE content_fts MATCH 'x'", "SELECT * FROM content_fts WHERE content_fts MATCH 'x AND'"):
        with pytest.raises(R.QueryError):
            I.with_full_text(tables, wrong)


def test_postings_are_written_without_dealing_tokens(spark, tmp_path, monkeypatch):
    """A row a term of a document, whatever the number of runs; the plan that writes them has no exchange."""
    docs = spark.createDataFrame([*DOCS, ("empty.txt", ""), ("none.txt", None)], "name string, text string").withColumn("relpath", F.col("name"))
    found = R.tokenised(docs, COLUMNS).coalesce(1)
    want = sorted(map(tuple, R.exploded(found, 2).collect()))
    for tokens in (1, 10**6):
        monkeypatch.setattr(R, "RUN", tokens)
        monkeypatch.setattr(R, "STEP", tokens)
        rows = R.grouped(found, 2)
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, R.ungrouped(rows, 2).collect())) == want
        got = [(r.term.encode(), r.relpath.encode()) for r in rows.collect()]
        assert len(set(got)) == len(got) and (got == sorted(got)) == (tokens > 1)
        assert all(r.p0 == sorted(r.p0) and r.p1 == sorted(r.p1) for r in rows.collect())
    assert {r.term: (r.n_docs, r.n_total) for r in R.term_stats(rows, 2).collect()} == {
        t: (len({r[0] for r in want if r[3] == t}), sum(r[3] == t for r in want)) for t in {r[3] for r in want}
    }
    tables = snapshot(spark, f"{tmp_path}/0", DOCS)
    plan = M.counts(tables.postings("content"), M.parse("NEAR(the of, 2)", ["text"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

import fnmatch
import sqlite3

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import paths, text

PATHS = ["loose.txt", "_ROOT/nested.txt", "docs/2026/report.txt", "docs/２０２６/report.txt", "docs/²⁰²⁶/r.txt", "a/1989/2020/x.tar.GZ", "a/2100/b", "2024", "a./.x", "a/b.", "a/2020\n/c.md", "x/1990/1995/e.PDF"]
TEXTS = ["Étude Étude e̱x", "foo-bar 2024_x ﬁ İ ß đ ς ϐ", "", "  \t\n ", "a.b:c d", "Größe naïve", "中文 text 12３", "x⃝y z"]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", expr(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


def test_paths(spark):
    assert column(spark, PATHS, paths.area) == [p.split("/")[0] if "/" in p else "." for p in PATHS]
    assert column(spark, PATHS, paths.path_year) == [None, None, 2026, None, None, 2020, None, None, None, None, None, 1990]
    names = [p.rsplit("/", 1)[-1] for p in PATHS]
    assert column(spark, names, paths.extension) == ["txt", "txt", "txt", "txt", "txt", "gz", "", "", "", "", "md", "pdf"]


def test_globs(spark):
    globs = ["a/*", "*.txt", "d?cs/**", "[!x]*/1990/*"]
    for g in globs:
        assert column(spark, PATHS, lambda c, g=g: c.rlike(paths.glob_pattern(g))) == [fnmatch.fnmatchcase(p, g) for p in PATHS]
    with pytest.raises(Exception, match="only in case"):
        column(spark, ["private/secret.txt"], lambda c: paths.matches_glob(c, ["Private/**"]))


def test_roots_and_pruning(spark):
    values = ["a", "a/b", "ab/c", "x/private/y", "docs/private"]
    assert column(spark, values, lambda c: paths.authorized(c, ["a"])) == [True, True, False, False, False]
    assert column(spark, values, lambda c: paths.authorized(c, ["."])) == [True] * 5
    assert column(spark, values, lambda c: paths.below_pruned(c, ["private"])) == [False, False, False, True, False]


def test_name_meta(spark):
    pattern = r"(?P<code>[A-Z]+)-(?P<n>\d+)(?P<odd>x)?"
    assert column(spark, ["AB-12.txt", "none", "Ü AB-1x"], lambda c: paths.name_meta(c, pattern)) == ['{"code": "AB", "n": "12"}', None, '{"code": "AB", "n": "1", "odd": "x"}']
    with pytest.raises(Exception, match="(?i)time"):
        column(spark, ["a" * 40 + "b"], lambda c: paths.name_meta(c, r"^(?P<name>(a|a)+(a|a)+)$"))


def test_blanks_and_nfc(spark):
    values = [*TEXTS, "".join(map(chr, range(1, 0x3100)))]
    assert column(spark, values, text.collapse_blanks) == [" ".join(v.split()) for v in values]
    import unicodedata

    assert column(spark, TEXTS, text.nfc) == [unicodedata.normalize("NFC", v) for v in TEXTS]


def test_tokens_are_those_of_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(TEXTS))
    want = [[t for (t,) in con.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (i,))] for i in range(len(TEXTS))]
    assert column(spark, TEXTS, text.tokens) == want
    assert [text.tokenize(t) for t in TEXTS] == want


def test_tsv_and_html(spark):
    assert column(spark, ["=formula\n", "=2+2", "left\r\x1b\x00right", "x", None], text.tsv_cell) == ["'=formula ", "'=2+2", "left   right", "x", ""]
    page = '<html><title>T</title><script>var a="<p>";</script><!-- x --><p>a&amp;b<b>fo</b>o&copy;</p></html>'
    assert column(spark, [page], text.html_text) == ["T a&b fo o©"]


def test_every_code_point_is_folded_as_by_fts5(spark):
    """One text for each code point, between letters and alone."""
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((i, f"a{chr(i)}b {chr(i)}") for i in points))
    want: dict[int, list[str]] = {}
    for doc, term in con.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want.setdefault(doc, []).append(term)

    @F.pandas_udf("string")
    def around(ids):
        return ids.map(lambda i: f"a{chr(i)}b {chr(i)}")

    got = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", text.tokens(around("id")).alias("t"))
    assert [(r.id, r.t, want[r.id]) for r in got.toLocalIterator() if r.t != want[r.id]] == []
    sample = [i for i in points if i % 97 == 0 or i < 0x3100]
    assert all(text.tokenize(f"a{chr(i)}b {chr(i)}") == want[i] for i in sample)


def test_tokens_of_batches_are_those_of_columns(spark):
    """Every code point between letters and alone, and bytes that are no UTF-8."""
    codes = text.code_table(text.fold_tables())
    points = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{chr(i)}b {chr(i)}" for i in points]
    n, found = text.find_tokens(pa.array(texts), codes)
    ends = [0, *n.cumsum().tolist()]
    found = found.to_pylist()
    rows = spark.createDataFrame(pd.DataFrame({"k": range(len(texts)), "x": texts})).select("k", text.tokens(F.col("x")).alias("t")).toLocalIterator()
    assert [r.k for r in rows if r.t != found[ends[r.k] : ends[r.k + 1]]] == []
    odd = ["", None, "a\nb", "\u0301", "e\u0301\u0301T", "A\x00b", " z"]
    n, found = text.find_tokens(pa.array(odd)[1:], codes)
    assert (n.tolist(), found.to_pylist()) == ([0, 2, 0, 1, 2, 1], ["a", "b", "et", "a", "b", "z"])
    wrong = pa.StringArray.from_buffers(2, pa.array([b"a\xffb", b"c"]).buffers()[1], pa.array([b"a\xffb", b"c"]).buffers()[2])
    assert text.find_tokens(wrong, codes)[1].to_pylist() == ["a", "b", "c"]

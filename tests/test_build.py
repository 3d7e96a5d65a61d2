import io
import os
import zipfile

import pytest

from tessera import cli
from tessera.plans import publish, sqlguard
from tessera.plans.build import BuildError, build
from tessera.plans.index import Index
from tessera.sources import config as C
from tessera.sources import extract as X
from tessera.sources.walk import WalkError, corpus_id, walk

W = 'xmlns:w="w"'


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def docx(body):
    return package(**{"word/document.xml": f"<w:d {W}>{body}</w:d>"})


@pytest.fixture
def setup(tmp_path):
    root, out = tmp_path / "corpus", tmp_path / "out"
    for p, data in {"docs/2024/needle-report.txt": "alpha needle beta", "docs/plain.md": "nothing here", "docs/page.html": "<p>needle <b>x</b><script>no</script>", "docs/w.docx": None, "old/a.doc": "x", "_x/.hidden": "h", "skip/z.txt": "needle", "docs/@eaDir/t.txt": "t"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(docx("<w:p>word needle</w:p>") if data is None else data.encode())
    os.mkfifo(root / "docs/pipe.txt")
    os.symlink("/etc/passwd", root / "docs/link.txt")
    out.mkdir()
    base = {"corpus_root": str(root), "publish_dir": str(out), "access_roots": ["."], "access_policy_id": "p", "access_policy_generation": "1", "prune_dirs": ["skip"], "smoke_term": "needle", "metadata_only_globs": ["_x/*"]}
    corpus_id(C.validate(base), create=True)
    return root, out, base


def test_build_search_and_rebuild(spark, setup, capsys):
    root, out, base = setup
    c = C.validate(base)
    snapshot = build(spark, c)
    index = Index(spark, str(out))
    assert index.path == snapshot
    status = index.status()
    assert status["content_status_breakdown"] == {"extracted": 4, "metadata_only": 1, "unsupported_format": 1}
    hits = index.search("needle")
    assert {(h["relpath"], h["matched_by"]) for h in hits} == {("docs/2024/needle-report.txt", "both"), ("docs/page.html", "content"), ("docs/w.docx", "content")}
    assert hits[0]["relpath"] == "docs/2024/needle-report.txt" and hits[0]["snippet"] == "alpha [needle] beta"
    assert [h["relpath"] for h in index.search("needle", year=2024)] == ["docs/2024/needle-report.txt"]
    assert [h["relpath"] for h in index.name("report", ext=".TXT")] == ["docs/2024/needle-report.txt"]
    assert index.sql("SELECT count(*) AS n FROM files WHERE ext = 'md'") == [{"n": 1}]

    (root / "docs/plain.md").write_text("changed text")
    (root / "new.csv").write_text("a,b")
    again = build(spark, c)
    assert again != snapshot and Index(spark, str(out)).status()["file_count"] == 7
    assert Index(spark, str(out)).search("changed")[0]["relpath"] == "docs/plain.md"
    assert cli.main(["--db", str(out), "name", "report", "--tsv"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("relpath\tfilename")
    assert cli.main(["sql", "DROP TABLE files", "--db", str(out)], spark) == 2

    for p in list((root / "docs").glob("*.*")) + [root / "new.csv", root / "old/a.doc"]:
        p.unlink()
    with pytest.raises(BuildError, match="dropped"):
        build(spark, c)
    assert Index(spark, str(out)).path == again


def test_policy(spark, setup):
    root, out, base = setup
    build(spark, C.validate(base))
    with pytest.raises(publish.PublicationError, match="without increasing"):
        build(spark, C.validate(base | {"prune_dirs": ["skip", "old"]}))
    with pytest.raises(publish.PublicationError, match="bound to another"):
        build(spark, C.validate(base | {"access_policy_id": "q"}))
    build(spark, C.validate(base | {"prune_dirs": ["skip", "old"], "access_policy_generation": "2"}))
    binding = publish.read_binding(str(out))
    assert binding["access_policy_generation"] == "2" and binding["transition_from"] is None
    with pytest.raises(publish.PublicationError, match="backwards"):
        build(spark, C.validate(base))
    want = publish.desired_binding(C.validate(base | {"access_policy_generation": "3"}), "0" * 64, binding["corpus_uuid"])
    assert publish.decide(str(out), want) == "advance"
    (out / "CURRENT").unlink()
    with pytest.raises(publish.PublicationError, match="baseline"):
        publish.decide(str(out), want)


def test_walk(setup):
    root, _, base = setup
    names = [r["relpath"] for r in walk(C.validate(base))]
    assert names == ["_x/.hidden", "docs/page.html", "docs/plain.md", "docs/w.docx", "docs/2024/needle-report.txt", "old/a.doc"]
    assert [r["relpath"] for r in walk(C.validate(base | {"access_roots": ["docs/2024", "old"]}))] == ["docs/2024/needle-report.txt", "old/a.doc"]
    with pytest.raises(WalkError, match="missing"):
        list(walk(C.validate(base | {"access_roots": ["gone"]})))
    with pytest.raises(WalkError, match="only in case"):
        list(walk(C.validate(base | {"prune_dirs": ["Docs"]})))
    with pytest.raises(WalkError, match="too many files"):
        list(walk(C.validate(base | {"max_total_files": 2})))
    with open(os.fsencode(root) + b"/bad\xff", "w"):
        pass
    with pytest.raises(WalkError, match="non-UTF-8"):
        list(walk(C.validate(base)))


@pytest.mark.parametrize("change", [{"x": 1}, {"access_roots": []}, {"access_roots": ["a", "a/b"]}, {"access_roots": [".", "a"]}, {"access_roots": ["../a"]}, {"prune_dirs": ["a/b"]}, {"prune_dirs": ["a", "A"]}, {"metadata_only_globs": ["/a"]}, {"publish_mode": "0666"}, {"publish_mode": "9"}, {"max_walk_retries": 11}, {"min_file_count": True}, {"access_policy_generation": "01"}, {"access_policy_generation": "9223372036854775808"}, {"smoke_term": " "}, {"corpus_id_file": "a/b"}, {"filename_pattern": "("}, {"allow_empty": 1}])
def test_config_rejections(setup, change):
    with pytest.raises(C.ConfigError):
        C.validate(setup[2] | change)


def test_extractors():
    for code, mark in (("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff")):
        assert X.decoded(mark + "año Δ".encode(code)) == "año Δ"
    assert X.decoded(b"caf\xe9") == "café"
    assert X.extract("text", b"\xff\xfe\x00") == ("error", "")
    assert X.extract("ooxml-word", docx("<w:p>one<w:r>two</w:r>three</w:p><w:tab/>four<w:p>five</w:p>six")) == ("extracted", "onetwothree four fivesix")
    assert X.extract("html", b"<b>fo</b>o <style>x</style>&amp; y") == ("extracted", "fo o & y")
    deep = "<a>" * 300 + "</a>" * 300
    assert X.extract("ooxml-word", package(**{"word/document.xml": deep}))[0] == "too_big"
    assert X.extract("ooxml-word", package(**{"word/document.xml": "<!DOCTYPE x><a/>"}))[0] == "error"
    assert X.extract("ooxml-word", package(other="x"))[0] == "error"
    assert X.extract("ooxml-word", b"no zip")[0] == "error"
    assert X.extract("text", b"x" * 600_000)[0] == "too_big"
    sheet = '<worksheet><c t="s"><v>0</v></c><c t="inlineStr"><is><t>inline</t></is></c><c><f>SUM(A1)</f><v>42</v></c><c t="s"><v>99</v></c></worksheet>'
    book = package(**{"xl/workbook.xml": '<workbook xmlns:r="r"><sheet name="Budget" r:id="x1"/></workbook>', "xl/_rels/workbook.xml.rels": '<R><r Id="x1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": "<sst><si><t>Shared</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert X.extract("ooxml-excel", book) == ("extracted", "Budget Shared inline SUM(A1) 42")
    assert X.extract("odf-text", package(**{"content.xml": "<o><p>ODT</p><h>x</h></o>"})) == ("extracted", "ODT x")
    data = bytearray(docx("x"))
    data[-12] = 2
    assert X.extract("ooxml-word", bytes(data))[0] == "error"


def test_sql_guard(spark):
    tables = {"t": spark.range(3000)}
    run = lambda q, seconds=60.0: sqlguard.run_sql(spark, q, tables, seconds)
    assert run("SELECT x'00FF' AS payload") == [{"payload": {"$blob": "AP8=", "encoding": "base64"}}]
    assert run("SELECT double('infinity') AS value") == [{"value": {"$float": "infinity"}}]
    assert run("WITH a AS (SELECT id FROM t WHERE id < 2) SELECT max(id) AS m FROM a") == [{"m": 1}]
    for bad in ("(SELECT 1)", "VALUES 1", "DROP TABLE t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM t", "SELECT (SELECT max(x) FROM other) AS y", "SELECT repeat('x', 2000000) AS big", "SELECT " + ", ".join(f"1 AS c{i}" for i in range(25))):
        with pytest.raises(sqlguard.SqlError):
            run(bad)
    with pytest.raises(sqlguard.SqlError, match="work budget"):
        run("SELECT count(*) AS n FROM t a, t b, t c WHERE a.id * 3 + b.id * 5 + c.id < 0", seconds=0.5)


def test_streaming_ingest(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    docs = spark.createDataFrame([("a", "red fox"), ("b", "red hen red")], "doc_id string, text string")
    docs.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out")).awaitTermination(120)
        docs.where("doc_id = 'b'").write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out/postings")).where("term = 'red'").count() == 3

"""Damaged snapshots, budgets while a build writes, and segments of rebuilds."""

import os
import shutil
import time

import pyarrow as pa
import pytest

from tessera import cli
from tessera.plans import build as B
from tessera.plans import publish
from tessera.plans.index import Index
from tessera.sources import config as C
from tessera.sources.walk import corpus_id


@pytest.fixture
def setup(tmp_path):
    root, out = tmp_path / "corpus", tmp_path / "out"
    root.mkdir()
    out.mkdir()
    for k in range(12):
        (root / f"f{k}.txt").write_text(f"word{k} needle")
    base = {"corpus_root": str(root), "publish_dir": str(out), "access_roots": ["."], "access_policy_id": "p", "access_policy_generation": "1"}
    corpus_id(C.validate(base), create=True)
    return root, out, base


def part(snapshot, table):
    return next(os.path.join(top, f) for top, _, fs in os.walk(f"{snapshot}/{table}") for f in sorted(fs) if f.endswith(".parquet"))


def test_damaged_snapshots_are_passed_over(spark, setup, capsys):
    root, out, base = setup
    c = C.validate(base)
    for harm in ("flip", "missing", "manifest"):
        snapshot = B.build(spark, c)
        at = part(snapshot, "content")
        data = bytearray(open(at, "rb").read())
        os.chmod(at, 0o600)
        if harm == "flip":
            data[len(data) // 2] ^= 255
            open(at, "wb").write(data)
        elif harm == "missing":
            os.unlink(at)
        else:
            os.chmod(f"{snapshot}/manifest.json", 0o600)
            open(f"{snapshot}/manifest.json", "w").write("{")
        with pytest.warns(UserWarning, match="can't be reused"):
            again = B.build(spark, c)
        assert Index(spark, str(out)).table("content").count() == 12
    assert publish.faults(spark, again) == []
    shutil.copy(part(again, "files"), f"{again}/files/part-extra.parquet")
    os.truncate(part(again, "content"), 9)
    assert sorted(f.rpartition(" ")[0].partition(" ")[2] for f in publish.faults(spark, again)) == ["has 9 bytes, not", "is not in the"]
    os.unlink(f"{again}/files/part-extra.parquet")
    os.chmod(at := part(again, "names_postings"), 0o600)
    open(at, "wb").write(b"PAR1 no file PAR1")
    assert cli.main(["--db", str(out), "name", "txt"], spark) == 2
    said = capsys.readouterr().err
    assert said.startswith("error: ") and "o1" not in said.split() and "An error occurred while calling" not in said


def test_damage_before_the_pointer_moves_stops_publication(spark, setup, monkeypatch):
    root, out, base = setup
    first = B.build(spark, C.validate(base))
    write = publish.write_manifest

    def harmed(spark, snapshot):
        write(spark, snapshot)
        with open(part(snapshot, "files"), "ab") as f:
            f.write(b"x")

    monkeypatch.setattr(publish, "write_manifest", harmed)
    (root / "f0.txt").write_text("changed")
    with pytest.raises(B.BuildError, match="damaged before"):
        B.build(spark, C.validate(base))
    assert publish.current(str(out)) == first and [n for n in os.listdir(out) if n.startswith("snapshot-")] == [os.path.basename(first)]


def test_rebuilds_add_segments_of_what_changed(spark, setup):
    root, out, base = setup
    c = C.validate(base)
    B.build(spark, c)
    (root / "f3.txt").write_text("other text here")
    (root / "f4.txt").unlink()
    snapshot = B.build(spark, c)
    assert {r.relpath for r in spark.read.parquet(f"{snapshot}/content_postings/segment=1").collect()} == {"f3.txt"}
    index = Index(spark, str(out))
    assert {h["relpath"] for h in index.search("needle")} == {f"f{k}.txt" for k in range(12) if k not in (3, 4)}
    assert [h["relpath"] for h in index.search("other")] == ["f3.txt"] and index.name("f4") == []
    got = index.sql("SELECT relpath, bm25(content_fts) AS b, snippet(content_fts, 0, '<', '>', '~', 8) AS s FROM content_fts WHERE content_fts MATCH 'other OR word7' ORDER BY 1")
    assert [(r["relpath"], r["s"]) for r in got] == [("f3.txt", "<other> text here"), ("f7.txt", "<word7> needle")]
    assert index.table("content_terms").where("term = 'needle'").first().n_docs == 10


def test_budgets_stop_jobs_while_they_write(spark, tmp_path):
    def slow(batches):
        for batch in batches:
            time.sleep(0.5)
            yield pa.RecordBatch.from_arrays([pa.array(["x" * 300_000] * batch.num_rows)], ["text"])

    def write(folder, **most):
        with B.Budgets(spark, str(folder), **{"most_text": 1 << 40, "most_size": 1 << 40} | most) as budgets:
            began = time.time()
            budgets.counted(spark.range(0, 400, 1, 200).mapInArrow(slow, "text string")).write.option("compression", "none").parquet(str(folder))
        return time.time() - began

    for name, most in (("max_total_extracted_mb", {"most_text": 3 << 20}), ("max_index_size_mb", {"most_size": 1 << 20})):
        began = time.time()
        with pytest.raises(B.BuildError, match=name):
            write(tmp_path / name, **most)
        assert time.time() - began < 8  # all of it takes over 12 s
    with pytest.raises(ZeroDivisionError), B.Budgets(spark, str(tmp_path), 1, 1 << 40):
        raise ZeroDivisionError
    assert spark.range(10).count() == 10


def test_a_build_over_its_text_budget_is_refused(spark, setup):
    root, out, base = setup
    for k in range(12):
        (root / f"f{k}.txt").write_text(f"{k} word " * 50_000)
    with pytest.raises(B.BuildError, match="max_total_extracted_mb"):
        B.build(spark, C.validate(base | {"max_total_extracted_mb": 1}))
    assert publish.current(str(out)) is None and not [n for n in os.listdir(out) if n.startswith("snapshot-")]

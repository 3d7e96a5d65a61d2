"""Adoption, transitions that were broken off, locks, and what a build or the command line finds by itself."""

import errno
import fcntl
import json
import os

import pyspark
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
    for name in ("a/needle-one.txt", "b/two.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"needle in {name}")
    out.mkdir()
    base = {"corpus_root": str(root), "publish_dir": str(out), "access_roots": ["."], "access_policy_id": "p", "access_policy_generation": "1", "smoke_term": "needle"}
    corpus_id(C.validate(base), create=True)
    return root, out, base


def test_a_snapshot_without_a_binding_is_adopted(spark, setup):
    _, out, base = setup
    first = B.build(spark, C.validate(base))
    held = publish.read_binding(str(out))
    (out / publish.BINDING).unlink()
    assert publish.decide(str(out), held) == "adopt"
    for change in ({"policy_digest": "0" * 64}, {"access_policy_id": "q"}, {"access_policy_generation": "2"}, {"corpus_uuid": "0" * 8 + held["corpus_uuid"][8:]}):
        with pytest.raises(publish.PublicationError, match="unbound snapshot of something else"):
            publish.decide(str(out), held | change)
    assert B.build(spark, C.validate(base)) != first and publish.read_binding(str(out)) == held


def test_a_transition_that_was_broken_off_is_resumed(spark, setup, monkeypatch):
    _, out, base = setup
    first, replace = B.build(spark, C.validate(base)), publish.replace_file
    higher = base | {"access_policy_generation": "2", "prune_dirs": ["b"]}

    held = next(p for p in (out / os.path.basename(first) / "files").iterdir() if p.suffix == ".parquet")
    data = held.read_bytes()
    held.write_bytes(data + b"x")
    with pytest.raises(publish.PublicationError, match="undamaged baseline"):
        B.build(spark, C.validate(higher))
    held.write_bytes(data)

    def broken(path, *rest):
        if os.path.basename(path) == publish.CURRENT:
            raise OSError(errno.EIO, "the disk is gone")
        replace(path, *rest)

    with monkeypatch.context() as m:
        m.setattr(publish, "replace_file", broken)
        with pytest.raises((OSError, B.BuildError)):
            B.build(spark, C.validate(higher))
    begun = publish.read_binding(str(out))
    assert publish.current(str(out)) == first
    assert begun["access_policy_generation"] == "2" and begun["transition_from"]["access_policy_generation"] == "1"
    with pytest.raises(publish.PublicationError, match="backwards"):
        B.build(spark, C.validate(base))
    for change in ({"prune_dirs": []}, {"access_policy_generation": "3"}):
        with pytest.raises(publish.PublicationError, match="pending transition"):
            B.build(spark, C.validate(higher | change))
    second = B.build(spark, C.validate(higher))
    assert publish.current(str(out)) == second != first
    assert publish.read_binding(str(out)) == begun | {"transition_from": None}
    assert [h["relpath"] for h in Index(spark, str(out)).search("needle")] == ["a/needle-one.txt"]


def test_a_marker_that_was_replaced_meanwhile(spark, setup, monkeypatch):
    root, out, base = setup
    config, write = C.validate(base), publish.write_manifest

    def touched(spark, snapshot):
        write(spark, snapshot)
        path = root / config["corpus_id_file"]
        text = path.read_text()
        path.unlink()
        path.write_text(text)

    monkeypatch.setattr(publish, "write_manifest", touched)
    with pytest.raises(B.BuildError, match="marker changed"):
        B.build(spark, config)
    assert publish.current(str(out)) is None and not [n for n in os.listdir(out) if n.startswith("snapshot-")]


@pytest.fixture
def bound(tmp_path):
    """A publication folder of generation 2, made by hand, and its binding."""
    binding = {"version": 1, "corpus_uuid": "12345678-1234-4234-8234-123456789abc", "access_policy_id": "p", "access_policy_generation": "2", "policy_digest": "a" * 64, "publish_mode": "0640", "publish_gid": os.getgid(), "transition_from": None}
    snapshot = tmp_path / ("snapshot-" + "0" * 32)
    snapshot.mkdir()
    meta = snapshot / "meta.json"
    meta.write_text(json.dumps({"schema_version": publish.SCHEMA_VERSION} | {k: binding[k] for k in ("corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest")}))
    meta.chmod(0o640)
    (tmp_path / publish.CURRENT).write_text(snapshot.name)
    (tmp_path / publish.BINDING).write_text(json.dumps(binding))
    return tmp_path, meta, binding


def test_permissions_that_drifted(bound):
    folder, meta, binding = bound
    higher = binding | {"access_policy_generation": "3"}

    def both(text):
        for want in (binding, higher):
            with pytest.raises(publish.PublicationError, match=text):
                publish.decide(str(folder), want)

    assert (publish.decide(str(folder), binding), publish.decide(str(folder), higher)) == ("current", "advance")
    meta.chmod(0o644)
    both("permissions")
    meta.chmod(0o640)
    os.link(meta, folder / "other")
    both("its own files")
    (folder / "other").unlink()
    (folder / publish.BINDING).write_text(json.dumps(binding | {"publish_gid": os.getgid() + 1}))
    with pytest.raises(publish.PublicationError, match="permissions"):
        publish.decide(str(folder), binding | {"publish_gid": os.getgid() + 1})


def test_either_side_of_a_transition_may_be_published(bound):
    folder, meta, binding = bound
    before = {k: binding[k] for k in ("policy_digest", "publish_mode", "publish_gid")} | {"access_policy_generation": "1"}
    (folder / publish.BINDING).write_text(json.dumps(binding | {"publish_mode": "0600", "transition_from": before}))
    want = binding | {"publish_mode": "0600"}
    for mode in (0o640, 0o600):
        meta.chmod(mode)
        assert publish.decide(str(folder), want) == "transition"
    meta.chmod(0o644)
    with pytest.raises(publish.PublicationError, match="permissions"):
        publish.decide(str(folder), want)


def test_a_baseline_must_be_that_of_the_binding(bound):
    folder, meta, binding = bound
    good = json.loads(meta.read_text())
    for change in ({"schema_version": 1}, {"policy_digest": "b" * 64}, {"access_policy_generation": "1"}):
        meta.write_text(json.dumps(good | change))
        with pytest.raises(publish.PublicationError, match="does not match the binding"):
            publish.decide(str(folder), binding | {"access_policy_generation": "3"})


def test_one_build_at_a_time(tmp_path, monkeypatch):
    with publish.locked(str(tmp_path)):
        with pytest.raises(publish.PublicationError, match="another build"), publish.locked(str(tmp_path)):
            pass
    with publish.locked(str(tmp_path)):
        pass

    def refused(*_):
        raise OSError(errno.ENOLCK, "No locks available")

    monkeypatch.setattr(fcntl, "flock", refused)
    with pytest.raises(publish.PublicationError, match="can't be taken: No locks available"), publish.locked(str(tmp_path)):
        pass


@pytest.mark.parametrize("change", [{"version": 2}, {"more": 1}, {"policy_digest": "x"}, {"corpus_uuid": "no"}, {"access_policy_generation": "01"}, {"publish_mode": "644"}, {"publish_gid": "1"}, {"transition_from": {"access_policy_generation": "1"}}])
def test_malformed_bindings(tmp_path, change):
    good = {"version": 1, "corpus_uuid": "12345678-1234-4234-8234-123456789abc", "access_policy_id": "p", "access_policy_generation": "2", "policy_digest": "a" * 64, "publish_mode": "0640", "publish_gid": None, "transition_from": None}
    (tmp_path / publish.BINDING).write_text(json.dumps(good))
    assert publish.read_binding(str(tmp_path)) == good
    (tmp_path / publish.BINDING).write_text(json.dumps(good | change))
    with pytest.raises(publish.PublicationError, match="malformed"):
        publish.read_binding(str(tmp_path))


def test_the_publication_folder_is_no_part_of_the_corpus(spark, setup):
    root, _, base = setup
    inside = root / "a" / "index"
    inside.mkdir()
    (inside / "old.txt").write_text("needle")
    config = C.validate(base | {"publish_dir": str(inside)})
    assert sorted(r.relpath for r in B.listed(spark, config).collect()) == ["a/needle-one.txt", "b/two.txt"]


def test_default_index(tmp_path, monkeypatch):
    package = tmp_path / "tools" / "tessera"
    package.mkdir(parents=True)
    monkeypatch.setattr(cli, "__file__", str(package / "cli.py"))
    assert cli.default_index() is None
    (tmp_path / "tools" / "meta.json").write_text("{}")
    assert cli.default_index() == str(tmp_path / "tools")
    (tmp_path / "CURRENT").write_text("snapshot")
    assert cli.default_index() == str(tmp_path)


def test_calls_that_are_refused(tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "__file__", str(tmp_path / "tools" / "tessera" / "cli.py"))
    assert cli.main(["status"], spark=object()) == 2 and "--db names one" in capsys.readouterr().err
    for call in (["--db", "a", "status", "--db=b"], ["search", "x", "--limit", "0"], ["search", "x", "--limit", "1001"], ["search", "x", "--db", ""], ["stat"]):
        with pytest.raises(SystemExit) as e:
            cli.main(call, spark=object())
        assert e.value.code == 2
    monkeypatch.setattr(pyspark, "__version__", "3.5.1")
    assert cli.main(["status"], spark=object()) == 2 and "PySpark 4" in capsys.readouterr().err

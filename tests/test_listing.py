"""Listing a tree by tasks, and the spelling of access roots."""

import os

import pytest

from tessera.sources import config as C
from tessera.sources.listing import listing, read_listed
from tessera.sources.walk import Changed, WalkError, walk


@pytest.fixture
def base(tmp_path):
    root = tmp_path / "corpus"
    for p in ("docs/a.txt", "docs/2024/b.txt", "docs/2024/deep/er/c.md", "old/x.doc", "_h/.y", "é/z.txt", "skip/s.txt", "top.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    (tmp_path / "out").mkdir()
    return {"corpus_root": str(root), "publish_dir": str(tmp_path / "out"), "access_roots": ["."], "access_policy_id": "p", "access_policy_generation": "1", "prune_dirs": ["skip"]}


def both(spark, tmp_path, given):
    """Rows of the listing, which are those of the walk; or the same error."""
    config = C.validate(given)
    try:
        want = sorted(tuple(r.values()) for r in walk(config))
    except WalkError as e:
        with pytest.raises(type(e)) as other:
            listing(spark, config, set(), str(tmp_path / "work"))
        assert str(other.value) == str(e)
        raise
    got = listing(spark, config, set(), str(tmp_path / "work"))
    assert sorted(map(tuple, got.collect())) == want
    return got


def test_listing_is_the_walk(spark, tmp_path, base):
    files = both(spark, tmp_path, base)
    assert files.count() == 7
    read = {r.relpath: bytes(r.data or b"") for r in read_listed(files, {"config": __import__("json").dumps(C.validate(base)), "limits": '{"txt": 1000}'}).collect()}
    assert read["docs/2024/b.txt"] == b"docs/2024/b.txt" and read["old/x.doc"] == b"" and len(read) == 7
    assert {r.relpath for r in both(spark, tmp_path, base | {"access_roots": ["docs/2024", "old"]}).collect()} == {"docs/2024/b.txt", "docs/2024/deep/er/c.md", "old/x.doc"}


@pytest.mark.parametrize("change,fault", [({"max_total_files": 3}, "too many files"), ({"max_total_entries": 4}, "in all"), ({"max_directory_entries": 3}, "too many entries in ''"), ({"max_directory_depth": 2}, "deeply"), ({"prune_dirs": ["Docs"]}, "only in case"), ({"access_roots": ["docs/gone"]}, "missing")])
def test_faults_are_those_of_the_walk(spark, tmp_path, base, change, fault):
    with pytest.raises(WalkError, match=fault):
        both(spark, tmp_path, base | change)


def test_routes_to_roots_must_be_spelled_as_on_disk(spark, tmp_path, base):
    with pytest.raises(WalkError, match="case or spelling"):
        both(spark, tmp_path, base | {"access_roots": ["Docs/2024"]})
    with pytest.raises(WalkError, match="case or spelling"):
        both(spark, tmp_path, base | {"access_roots": ["e\u0301"]})  # the same letter in another form
    os.makedirs(f"{base['corpus_root']}/DOCS")
    with pytest.raises(WalkError, match="case or spelling"):  # the exact name, and an alias of it
        both(spark, tmp_path, base | {"access_roots": ["docs/2024"]})
    with pytest.raises(Changed, match="missing"):
        both(spark, tmp_path, base | {"access_roots": ["old/x"]})
    with pytest.raises(WalkError, match="too many entries"):  # the look for aliases is bounded
        both(spark, tmp_path, base | {"access_roots": ["old"], "max_directory_entries": 3})

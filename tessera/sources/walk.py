"""A file tree as a Spark data source.

The driver lists the tree (names and stat results, no content); tasks read the
files, a batch of paths each.  Symbolic links and what is neither folder nor
regular file are left out; anything that can't be read aborts the walk, as do the
configured budgets.  Hidden and underscored names are listed like any other.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import stat
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .config import BUILT_IN_PRUNE, nfc


class WalkError(RuntimeError):
    """The tree can't be indexed as it is."""


class Changed(WalkError):
    """The tree changed while it was read; the walk may be tried again."""


def relevant(rel: str, roots: list[str]) -> bool:
    """Whether a folder is a root, below one, or on the way to one."""
    return any(r == "." or rel == "" or rel == r or rel.startswith(r + "/") or r.startswith(rel + "/") for r in roots)


def authorized(rel: str, roots: list[str]) -> bool:
    return any(r == "." or rel == r or rel.startswith(r + "/") for r in roots)


def pruned(name: str, names: list[str]) -> bool:
    plain = nfc(name)
    if plain in names:
        return True
    if near := next((n for n in names if n.casefold() == plain.casefold()), None):
        raise WalkError(f"folder {name!r} differs from the pruned {near!r} only in case")
    return False


def next_names(rel: str, roots: list[str]) -> set[str] | None:
    """On the way to roots, the names that lead on; None for a folder that is itself to be listed."""
    if "." in roots or (rel and authorized(rel, roots)):
        return None
    before = f"{rel}/" if rel else ""
    return {r[len(before) :].split("/", 1)[0] for r in roots if r.startswith(before) and r != rel}


def _exact(rel: str, wanted: set[str], names: list[str]) -> None:
    """Names on the way to a root must be there as spelled, and no other spelling of them."""
    folded = {nfc(n).casefold() for n in wanted}
    for n in names:
        if n not in wanted and not any(0xD800 <= ord(c) < 0xE000 for c in n) and nfc(n).casefold() in folded:
            raise WalkError(f"an access root differs in case or spelling from {n!r} in {rel or '.'!r}")
    if missing := sorted(wanted - set(names)):
        raise Changed(f"access roots are missing: no {missing} in {rel or '.'!r}")


@dataclass
class Folder:
    """What a folder holds: rows of files, paths of folders to go on with, roots found, and how many entries count."""

    files: list[dict]
    folders: list[str]
    found: set[str]
    entries: int


def folder(config: dict, rel: str, skip: set[tuple[int, int]] = frozenset()) -> Folder:
    """List one folder, in byte order of its names; entries beyond the configured number aren't even looked at."""
    root, roots = config["corpus_root"], config["access_roots"]
    if rel.count("/") + bool(rel) > config["max_directory_depth"]:
        raise WalkError(f"folders are nested too deeply: {rel!r}")
    try:
        with os.scandir(os.path.join(root, rel)) as entries:
            listed = list(itertools.islice(entries, config["max_directory_entries"] + 1))
    except FileNotFoundError as e:
        raise Changed(str(e)) from None
    except OSError as e:
        raise WalkError(f"can't read folder {rel!r}: {e}") from None
    if len(listed) > config["max_directory_entries"]:
        raise WalkError(f"too many entries in {rel!r}")
    wanted = next_names(rel, roots)
    if wanted is not None:
        _exact(rel, wanted, [e.name for e in listed])
        listed = [e for e in listed if e.name in wanted]
    out = Folder([], [], set(), len(listed))
    names = BUILT_IN_PRUNE + config["prune_dirs"]
    for e in sorted(listed, key=lambda e: os.fsencode(e.name)):
        path = f"{rel}/{e.name}" if rel else e.name
        # On the way to a root, siblings are nobody's business.
        if not relevant(path, roots) or e.is_symlink() or (not rel and e.name == config["corpus_id_file"]):
            continue
        try:
            e.name.encode()
        except UnicodeEncodeError:
            raise WalkError(f"non-UTF-8 bytes in a name: {os.fsencode(e.name).hex()}") from None
        if e.is_dir(follow_symlinks=False):
            if skip and (e.stat(follow_symlinks=False).st_dev, e.inode()) in skip:
                continue
            if not pruned(e.name, names):
                out.folders.append(path)
                out.found.update(r for r in roots if r == path)
            continue
        if not authorized(path, roots):
            continue
        s = e.stat(follow_symlinks=False)
        if not stat.S_ISREG(s.st_mode) or (s.st_dev, s.st_ino) in skip:
            continue
        if not os.access(os.path.join(root, path), os.R_OK):
            raise WalkError(f"can't read {path!r}")
        out.found.update(r for r in roots if r == path)
        out.files.append({"relpath": path, "size_bytes": s.st_size, "mtime_ns": s.st_mtime_ns, "ctime_ns": s.st_ctime_ns, "st_dev": str(s.st_dev), "st_ino": str(s.st_ino)})
    return out


def check_totals(config: dict, entries: int, files: int) -> None:
    if entries > config["max_total_entries"]:
        raise WalkError("too many entries in all")
    if files > config["max_total_files"]:
        raise WalkError("too many files")


def check_roots(config: dict, found: set[str]) -> None:
    if missing := [r for r in config["access_roots"] if r != "." and r not in found]:
        raise Changed(f"access roots are missing: {missing}")


def walk(config: dict, skip: set[tuple[int, int]] = frozenset()) -> Iterator[dict]:
    """Rows of all regular files in byte order of their names, folder by folder."""
    entries = files = 0
    found: set[str] = set()
    stack: list[str] = [""]
    while stack:
        here = folder(config, stack.pop(), skip)
        entries, files = entries + here.entries, files + len(here.files)
        check_totals(config, entries, files)
        found |= here.found
        yield from here.files
        stack += reversed(here.folders)
    check_roots(config, found)


def read_unchanged(root: str, row: dict, most: int | None) -> bytes | None:
    """The bytes of a listed file, read once; None if it has more than ``most``."""
    if most is not None and row["size_bytes"] > most:
        return None
    fd = os.open(os.path.join(root, row["relpath"]), os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    with os.fdopen(fd, "rb") as f:
        before = os.fstat(f.fileno())
        data = f.read(row["size_bytes"] + 1)
        after = os.fstat(f.fileno())
    for s in (before, after):
        if not stat.S_ISREG(s.st_mode) or (str(s.st_dev), str(s.st_ino), s.st_size, s.st_mtime_ns) != (row["st_dev"], row["st_ino"], row["size_bytes"], row["mtime_ns"]):
            raise Changed(f"changed while read: {row['relpath']!r}")
    return data


class _Batch(InputPartition):
    def __init__(self, rows: list[dict]):
        self.value = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.config = json.loads(options["config"])
        self.limits = json.loads(options.get("limits", "{}"))
        self.batch = int(options.get("batch", "256"))
        self.skip = {tuple(x) for x in json.loads(options.get("skip", "[]"))}

    def partitions(self):
        out, batch = [], []
        for row in walk(self.config, self.skip):
            batch.append(row)
            if len(batch) == self.batch:
                out.append(_Batch(batch))
                batch = []
        return out + [_Batch(batch)] if batch or not out else out

    def read(self, partition):
        for r in partition.value:
            ext = nfc(r["relpath"]).rsplit("/", 1)[-1].rpartition(".")
            most = self.limits.get(ext[2].lower() if ext[0] else "")
            data = read_unchanged(self.config["corpus_root"], r, most) if most is not None else None
            yield (r["relpath"], r["size_bytes"], r["mtime_ns"], r["ctime_ns"], r["st_dev"], r["st_ino"], hashlib.sha256(data).hexdigest() if data is not None else None, data)


class CorpusSource(DataSource):
    """``format("corpus")``: options ``config`` (JSON), ``limits`` (JSON, extension to most bytes read), ``batch``, ``skip``."""

    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return "relpath string, size_bytes long, mtime_ns long, ctime_ns long, st_dev string, st_ino string, source_hash string, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def corpus_id(config: dict, create: bool = False) -> str:
    """The UUID in the corpus marker; ``create`` makes one where there is none."""
    if create:
        path = os.path.join(config["corpus_root"], config["corpus_id_file"])
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600)
        with os.fdopen(fd, "w") as f:
            f.write(f"{uuid.uuid4()}\n")
            f.flush()
            os.fsync(f.fileno())
    return corpus_marker(config)[0]


def corpus_marker(config: dict) -> tuple[str, tuple[int, ...]]:
    """The UUID in the corpus marker, and what tells whether the file was written or replaced since."""
    try:
        fd = os.open(os.path.join(config["corpus_root"], config["corpus_id_file"]), os.O_RDONLY | os.O_NOFOLLOW)
    except OSError as e:
        raise WalkError(f"no corpus marker: {e}") from None
    with os.fdopen(fd, "rb") as f:
        text = f.read(100).decode("ascii", "replace").strip()
        s = os.fstat(f.fileno())
    try:
        known = str(uuid.UUID(text))
    except ValueError:
        known = ""
    if known != text:
        raise WalkError("the corpus marker is not a UUID")
    return text, (s.st_dev, s.st_ino, s.st_mode, s.st_size, s.st_mtime_ns, s.st_ctime_ns)

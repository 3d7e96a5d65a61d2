"""Publication: immutable snapshots, one pointer, and a binding that outlives both.

A publication folder holds ``snapshot-<uuid>`` folders, ``CURRENT`` (the name of
the one in use) and ``binding.json``, which ties the folder to one corpus, policy
and generation.  Every change goes through a new file and ``os.replace``.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import shutil
import stat
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

from ..schema import SCHEMA_VERSION
from ..sources.config import canonical_generation

BINDING, CURRENT, LOCK, MANIFEST = "binding.json", "CURRENT", "lock", "manifest.json"
#: Files of a snapshot, more than a build makes, and bytes of its manifest that are read at most.
MAX_FILES, MAX_MANIFEST = 1_000_000, 256 << 20
_KEYS = {"version", "corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest", "publish_mode", "publish_gid", "transition_from"}
_HELD = ("access_policy_generation", "policy_digest", "publish_mode", "publish_gid")


class PublicationError(RuntimeError):
    """The folder may not be published to as asked."""


@contextmanager
def locked(folder: str):
    with open(os.path.join(folder, LOCK), "a") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise PublicationError("another build holds the publication lock") from None
        except OSError as e:
            raise PublicationError(f"the publication lock can't be taken: {e.strerror}") from None
        yield


def replace_file(path: str, text: str, mode: int = 0o640) -> None:
    new = f"{path}.{uuid.uuid4().hex}"
    fd = os.open(new, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, mode)
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)
    folder = os.open(os.path.dirname(path), os.O_RDONLY)
    os.fsync(folder)
    os.close(folder)


def check_binding(b: object) -> dict:
    """A binding with the right keys, types and forms."""
    ok = isinstance(b, dict) and set(b) == _KEYS and b["version"] == 1
    ok = ok and all(isinstance(b[k], str) and b[k] for k in ("corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest", "publish_mode"))
    ok = ok and canonical_generation(b["access_policy_generation"]) and re.fullmatch("[0-9a-f]{64}", b["policy_digest"]) and re.fullmatch("0[0-7]{3}", b["publish_mode"])
    ok = ok and (b["publish_gid"] is None or type(b["publish_gid"]) is int)
    if ok:
        try:
            ok = str(uuid.UUID(b["corpus_uuid"])) == b["corpus_uuid"]
        except ValueError:
            ok = False
    before = b["transition_from"] if ok else None
    if ok and before is not None:
        ok = isinstance(before, dict) and set(before) == set(_HELD) and canonical_generation(str(before["access_policy_generation"])) and int(before["access_policy_generation"]) < int(b["access_policy_generation"])
    if not ok:
        raise PublicationError("the publication binding is malformed")
    return b


def read_binding(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, BINDING), "rb") as f:
            return check_binding(json.loads(f.read().decode()))
    except FileNotFoundError:
        return None
    except ValueError:
        raise PublicationError("the publication binding is malformed") from None


def desired_binding(config: dict, digest: str, corpus: str) -> dict:
    import grp

    gid = grp.getgrnam(config["publish_group"]).gr_gid if config["publish_group"] else None
    return {
        "version": 1, "corpus_uuid": corpus, "access_policy_id": config["access_policy_id"], "access_policy_generation": config["access_policy_generation"],
        "policy_digest": digest, "publish_mode": f"{config['publish_mode_int']:04o}", "publish_gid": gid, "transition_from": None,
    }


def current(folder: str) -> str | None:
    """The snapshot in use."""
    try:
        with open(os.path.join(folder, CURRENT)) as f:
            name = f.read().strip()
    except FileNotFoundError:
        return None
    if not re.fullmatch("snapshot-[0-9a-f]{32}", name) or not os.path.isdir(os.path.join(folder, name)):
        raise PublicationError("CURRENT does not name a snapshot")
    return os.path.join(folder, name)


def read_meta(snapshot: str) -> dict:
    try:
        with open(os.path.join(snapshot, "meta.json")) as f:
            return json.load(f)
    except (OSError, ValueError):
        raise PublicationError("the snapshot has no readable meta.json") from None


def _listed(snapshot: str) -> dict[str, int]:
    """Size of each file that readers open, by its path in the snapshot."""
    out = {}
    for top, _, names in os.walk(snapshot):
        for n in names:
            if n.endswith(".parquet") or (top == snapshot and n == "meta.json"):
                path = os.path.join(top, n)
                out[os.path.relpath(path, snapshot)] = os.path.getsize(path)
    return out


def hashes(spark: SparkSession, snapshot: str, names: list[str], sync: bool = False) -> dict[str, str]:
    """SHA-256 of files of a snapshot, read by tasks in pieces and brought to disk first with ``sync``; ``unreadable`` for those that can't be read."""

    def run(batches):
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    with open(os.path.join(snapshot, name), "rb") as f:
                        if sync:
                            os.fsync(f.fileno())
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                except OSError:
                    found.append("unreadable")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["name", "sha256"])

    if not names:
        return {}
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), spark.sparkContext.defaultParallelism))
    return {r.name: r.sha256 for r in df.mapInArrow(run, "name string, sha256 string").collect()}


def write_manifest(spark: SparkSession, snapshot: str) -> None:
    sizes = _listed(snapshot)
    found = hashes(spark, snapshot, sorted(sizes), sync=True)
    for top, _, _ in os.walk(snapshot):
        folder = os.open(top, os.O_RDONLY)
        os.fsync(folder)
        os.close(folder)
    replace_file(os.path.join(snapshot, MANIFEST), json.dumps({n: [sizes[n], found[n]] for n in sorted(sizes)}))


def read_manifest(snapshot: str) -> dict[str, tuple[int, str]]:
    try:
        with open(os.path.join(snapshot, MANIFEST), "rb") as f:
            raw = f.read(MAX_MANIFEST + 1)
        found = json.loads(raw.decode()) if len(raw) <= MAX_MANIFEST else None
        if not isinstance(found, dict) or len(found) > MAX_FILES or any(n.startswith("/") or ".." in n.split("/") for n in found):
            raise ValueError
        return {n: (int(size), str(digest)) for n, (size, digest) in found.items()}
    except (OSError, ValueError, TypeError):
        raise PublicationError("the snapshot has no readable manifest.json") from None


def faults(spark: SparkSession, snapshot: str) -> list[str]:
    """What differs from the manifest: files that are missing, new, of another size or, if none is, of other content."""
    want, have = read_manifest(snapshot), _listed(snapshot)
    out = [f"{n} is missing" for n in want if n not in have] + [f"{n} is not in the manifest" for n in have if n not in want]
    out += [f"{n} has {have[n]} bytes, not {size}" for n, (size, _) in want.items() if n in have and have[n] != size]
    if not out:
        found = hashes(spark, snapshot, sorted(want))
        out = [f"{n} was changed" for n, (_, digest) in want.items() if found.get(n) != digest]
    return out


def check_permissions(snapshot: str, states: list[dict]) -> None:
    """The published ``meta.json`` must be a file of its own with the mode and group of one of ``states``."""
    found = os.lstat(os.path.join(snapshot, "meta.json"))
    if not stat.S_ISREG(found.st_mode) or found.st_nlink != 1:
        raise PublicationError("the published snapshot is no longer made of its own files")
    if not any(stat.S_IMODE(found.st_mode) == int(b["publish_mode"], 8) and b["publish_gid"] in (None, found.st_gid) for b in states):
        raise PublicationError("the permissions of the published snapshot were changed")


def decide(folder: str, want: dict) -> str:
    """``create``, ``adopt``, ``current``, ``advance`` or ``transition``; or an error.

    Generations never go back; rules and permissions change only with a higher
    one; and a higher one needs the old snapshot, as its baseline.
    """
    have = read_binding(folder)
    if have is None:
        if (snapshot := current(folder)) is None:
            return "create"
        meta = read_meta(snapshot)
        if any(meta.get(k) != want[k] for k in ("corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest")):
            raise PublicationError("the folder holds an unbound snapshot of something else")
        return "adopt"
    if any(have[k] != want[k] for k in ("corpus_uuid", "access_policy_id")):
        raise PublicationError("the folder is bound to another corpus or policy")
    old, new = (int(b["access_policy_generation"]) for b in (have, want))
    if new < old:
        raise PublicationError(f"generation {old} is published; going backwards to {new} is refused")
    same = all(have[k] == want[k] for k in _HELD)
    if have["transition_from"] is not None:
        if not same:
            raise PublicationError("finish the pending transition first, as it was begun")
        if snapshot := current(folder):
            check_permissions(snapshot, [have, have["transition_from"]])
        return "transition"
    if new == old:
        if not same:
            raise PublicationError("rules or permissions changed without increasing access_policy_generation")
        if snapshot := current(folder):
            check_permissions(snapshot, [have])
        return "current"
    if (snapshot := current(folder)) is None:
        raise PublicationError("a higher generation needs the published snapshot as its baseline")
    check_permissions(snapshot, [have])
    meta = read_meta(snapshot)
    if meta.get("schema_version") != SCHEMA_VERSION or any(meta.get(k) != have[k] for k in ("corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest")):
        raise PublicationError("the published snapshot does not match the binding")
    return "advance"


def publish(folder: str, snapshot: str, want: dict, action: str) -> None:
    """Put a finished snapshot in use; an interrupted advance is resumed as a transition."""
    path, mode = os.path.join(folder, BINDING), int(want["publish_mode"], 8)
    if action == "advance":
        have = read_binding(folder)
        replace_file(path, json.dumps(want | {"transition_from": {k: have[k] for k in _HELD}}))
    for top, dirs, files in os.walk(snapshot):
        for d in [top, *(os.path.join(top, x) for x in dirs)]:
            os.chmod(d, mode | (mode & 0o444) >> 2)
        for f in files:
            os.chmod(os.path.join(top, f), mode)
            if want["publish_gid"] is not None:
                os.chown(os.path.join(top, f), -1, want["publish_gid"])
    replace_file(os.path.join(folder, CURRENT), os.path.basename(snapshot), mode)
    if action != "current":
        replace_file(path, json.dumps(want))


def retain(folder: str, keep: set[str | None]) -> None:
    """Remove all snapshots but these (the one in use and the one before it, which readers may still have open)."""
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.startswith("snapshot-") and path not in keep:
            shutil.rmtree(path, ignore_errors=True)

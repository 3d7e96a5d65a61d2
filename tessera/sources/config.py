"""The build configuration: a JSON object with a fixed set of keys."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from pathlib import PurePosixPath

MAX_GENERATION = 2**63 - 1
_NEEDED = object()


class ConfigError(ValueError):
    """A configuration that can't be used (exit code 2)."""


# Keys, types, defaults and ranges.
SPEC = {
    "corpus_root": (str, _NEEDED, None),
    "publish_dir": (str, _NEEDED, None),
    "corpus_id_file": (str, ".corpus-id", None),
    "access_roots": (list, _NEEDED, None),
    "access_policy_id": (str, _NEEDED, None),
    "access_policy_generation": (str, _NEEDED, None),
    "prune_dirs": (list, [], None),
    "metadata_only_globs": (list, [], None),
    "filename_pattern": ((str, type(None)), None, None),
    "smoke_term": ((str, type(None)), None, None),
    "allow_empty": (bool, False, None),
    "min_file_count": (int, 1, (0, None)),
    "max_file_count_drop_fraction": ((int, float), 0.5, (0, 1)),
    "max_walk_retries": (int, 2, (0, 10)),
    "max_directory_entries": (int, 50_000, (1, 1_000_000)),
    "max_directory_depth": (int, 128, (1, 512)),
    "max_total_entries": (int, 2_000_000, (1, 10_000_000)),
    "max_total_files": (int, 1_000_000, (1, 10_000_000)),
    "max_total_extracted_mb": (int, 1_024, (1, 1 << 20)),
    "max_index_size_mb": (int, 2_048, (1, 1 << 20)),
    "pdf_memory_limit_mb": (int, 512, (128, 4_096)),
    "publish_mode": (str, "0640", None),
    "publish_group": ((str, type(None)), None, None),
}
#: Folder names that are never entered.
BUILT_IN_PRUNE = ["@eaDir", "#recycle"]


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def need(ok: object, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _tidy(key: str, value: str) -> None:
    need(value.strip(), f"{key} must not be empty")
    need(value == value.strip(), f"{key} must not have blanks around it")


def canonical_generation(text: str) -> bool:
    return bool(re.fullmatch("0|[1-9][0-9]{0,18}", text)) and int(text) <= MAX_GENERATION


def _typed(data: object) -> dict:
    need(isinstance(data, dict), "the configuration must be a JSON object")
    need(not (more := sorted(set(data) - set(SPEC))), f"unknown keys: {', '.join(more)}")
    out = {}
    for key, (kind, default, between) in SPEC.items():
        value = data.get(key, default)
        need(value is not _NEEDED, f"missing key: {key}")
        need(isinstance(value, kind) and (kind is bool or not isinstance(value, bool)), f"{key} has the wrong type")
        items = value if isinstance(value, list) else [value]
        need(not isinstance(value, list) or all(isinstance(x, str) for x in value), f"{key} must be a list of strings")
        need(not any("\ud800" <= c <= "\udfff" for x in items if isinstance(x, str) for c in x), f"{key} has a lone surrogate")
        if between:
            need(value >= between[0] and (between[1] is None or value <= between[1]), f"{key} must be from {between[0]} to {between[1]}")
        out[key] = list(value) if isinstance(value, list) else value
    return out


def _distinct(key: str, values: list[str]) -> None:
    folded = [nfc(v).casefold() for v in values]
    need(len(set(folded)) == len(folded), f"{key} has entries that differ at most in case")


def validate(data: object) -> dict:
    c = _typed(data)
    for key in ("corpus_root", "publish_dir", "access_policy_id", "access_policy_generation"):
        _tidy(key, c[key])
    need(canonical_generation(c["access_policy_generation"]), "access_policy_generation must be a decimal integer without leading zeros, at most 2**63 - 1")
    need(len(c["access_policy_id"].encode()) <= 256, "access_policy_id is over 256 bytes")
    for key in ("corpus_root", "publish_dir"):
        need(os.path.isabs(c[key]), f"{key} must be absolute")
    need(os.path.realpath(c["corpus_root"]) != os.path.realpath(c["publish_dir"]), "publish_dir must not be corpus_root")

    c["prune_dirs"] = [nfc(n) for n in c["prune_dirs"]]
    for n in c["prune_dirs"]:
        _tidy("prune_dirs entry", n)
        need("/" not in n and "\\" not in n and n not in (".", ".."), f"a prune_dirs entry must be one folder name: {n!r}")
    _distinct("prune_dirs", c["prune_dirs"])

    c["metadata_only_globs"] = [nfc(g) for g in c["metadata_only_globs"]]
    for g in c["metadata_only_globs"]:
        _tidy("metadata_only_globs entry", g)
        need("\\" not in g and not set(g.split("/")) & {"", ".", ".."}, f"not a clean relative pattern: {g!r}")

    need(c["access_roots"], "access_roots must not be empty")
    for r in c["access_roots"]:
        _tidy("access_roots entry", r)
        if os.path.isabs(r):
            base = os.path.realpath(c["corpus_root"])
            need(r == base or r.startswith(base + "/"), f"an access root is outside corpus_root: {r!r}")
        else:
            need("\\" not in r and (r == "." or not set(r.split("/")) & {"", ".", ".."}), f"not a clean relative path: {r!r}")
    base = os.path.realpath(c["corpus_root"])
    c["access_roots"] = [os.path.relpath(r, base) if os.path.isabs(r) else str(PurePosixPath(r)) for r in c["access_roots"]]
    _distinct("access_roots", c["access_roots"])
    roots = c["access_roots"]
    need("." not in roots or len(roots) == 1, "the access root '.' is everything already")
    need(not any(a != b and b.startswith(a + "/") for a in roots for b in roots), "one access root lies in another")

    c["corpus_id_file"] = nfc(c["corpus_id_file"])
    _tidy("corpus_id_file", c["corpus_id_file"])
    need(not set(c["corpus_id_file"]) & {"/", "\\"} and c["corpus_id_file"] not in (".", ".."), "corpus_id_file must be one file name")
    need(c["smoke_term"] is None or c["smoke_term"].strip(), "smoke_term must not be blank")
    need(re.fullmatch("0?[0-7]{3}", c["publish_mode"]), "publish_mode must be octal")
    c["publish_mode_int"] = mode = int(c["publish_mode"], 8)
    need(not mode & 0o022, "publish_mode must not let others write")
    need(mode & 0o600 == 0o600, "publish_mode must let the owner read and write")
    if c["publish_group"] is not None:
        _tidy("publish_group", c["publish_group"])
    if c["filename_pattern"] is not None:
        try:
            re.compile(c["filename_pattern"])
        except re.error as e:
            raise ConfigError(f"filename_pattern: {e}") from None
    return c


def load(path: str) -> dict:
    need(os.path.isfile(path), f"no such file: {path}")
    try:
        with open(path, "rb") as f:
            data = json.loads(f.read().decode("utf-8-sig"))
    except ValueError as e:
        raise ConfigError(f"not UTF-8 JSON: {e}") from None
    return validate(data)


def policy_digest(c: dict) -> str:
    """SHA-256 of what decides who may read what."""
    import hashlib

    keys = ["access_policy_generation", "access_policy_id", "access_roots", "metadata_only_globs", "prune_dirs", "publish_group", "publish_mode"]
    # Lists count as sets, and the mode by its value.
    rules = {k: sorted(c[k]) if isinstance(c[k], list) else c[k] for k in keys}
    rules["publish_mode"] = f"{int(str(c['publish_mode']), 8):04o}"
    return hashlib.sha256(json.dumps(rules, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

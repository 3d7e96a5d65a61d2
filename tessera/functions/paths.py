"""Columns derived from a relative path."""

from __future__ import annotations

import fnmatch
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXTRACTORS, SOURCE_LIMITS, UNSUPPORTED

#: Seconds that the name pattern may take for one name.
PATTERN_SECONDS = 0.1


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def area(path: Column) -> Column:
    """The first segment, or ``.`` for a file at the top."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.substring_index(path, "/", 1))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def path_year(path: Column) -> Column:
    """The first folder that is a year from 1990 to 2099 in ASCII digits."""
    return F.try_element_at(F.filter(folders(path), lambda x: x.rlike(r"\A(199[0-9]|20[0-9]{2})\z")), F.lit(1)).cast("int")


def extension(name: Column) -> Column:
    """In lower case, after the last dot; empty if that is missing, first or last."""
    last = F.substring_index(name, ".", -1)
    return F.when((F.instr(name, ".") == 0) | (F.length(name) - F.length(last) <= 1), "").otherwise(F.lower(last))


def extractor(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, group in EXTRACTORS.items():
        out = F.when(ext.isin(group), label).otherwise(out)
    return out


def name_meta(name: Column, pattern: str | None) -> Column:
    """JSON of the pattern's named groups that took part in its first match, else null.

    A name on which the pattern takes over ``PATTERN_SECONDS`` fails the job.
    """
    if pattern is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        import regex

        compiled = regex.compile(pattern)

        def one(text):
            found = compiled.search(text, timeout=PATTERN_SECONDS) if text is not None else None
            groups = {k: v for k, v in found.groupdict().items() if v is not None} if found else {}
            return json.dumps(groups, ensure_ascii=False, sort_keys=True) if groups else None

        return names.map(one)

    return run(name)


def glob_pattern(glob: str) -> str:
    """The Java pattern of an fnmatch glob, in which ``*`` crosses slashes."""
    text = fnmatch.translate(unicodedata.normalize("NFC", glob))
    for end in (r"\Z", r"\z"):
        text = text.removesuffix(end)
    return rf"\A{text}\z"


def matches_glob(path: Column, globs: list[str]) -> Column:
    """Whether a glob fits.  A glob that fits only when case is ignored fails the job."""
    hit = miss = F.lit(False)
    for g in globs:
        exact = path.rlike(glob_pattern(g))
        hit, miss = hit | exact, miss | (~exact & path.rlike("(?iu)" + glob_pattern(g)))
    return F.when(hit, True).when(miss, F.raise_error(F.concat(F.lit("path differs from a metadata-only glob only in case: "), path)).cast("boolean")).otherwise(False) if globs else F.lit(False)


def authorized(path: Column, roots: list[str]) -> Column:
    """Whether the path is a root, or below one; ``.`` is everything."""
    out = F.lit("." in roots)
    for r in roots:
        out = out | (path == r) | F.startswith(path, F.lit(r + "/"))
    return out


def below_pruned(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path has one of these names."""
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, names)).cast("array<string>"))


def source_limit(ext: Column) -> Column:
    """The most bytes that an extractor reads; null if there is none."""
    label, out = extractor(ext), F.lit(None).cast("long")
    for name, most in SOURCE_LIMITS.items():
        out = F.when(label == name, F.lit(most).cast("long")).otherwise(out)
    return out


def early_status(path: Column, ext: Column, size: Column, globs: list[str]) -> Column:
    """The state of files that are not read, else null: the first that applies."""
    return (
        F.when(matches_glob(path, globs), "metadata_only")
        .when(ext.isin(UNSUPPORTED), "unsupported_format")
        .when(extractor(ext).isNull(), "no_text_type")
        .when(size > source_limit(ext), "too_big")
    )

"""A file tree listed by tasks, one level of folders at a time.

Each level is a job over the folders that the level before found; its rows are written
to the shared folder, and the driver sees sums, the access roots found and the first
fault.  So a tree of any number of names is listed with a bounded driver, within the
budgets and with the faults of ``walk``.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .walk import Changed, CorpusSource, WalkError, _Reader, check_roots, check_totals, folder

_STAT = ["size_bytes", "mtime_ns", "ctime_ns", "st_dev", "st_ino"]
_KINDS = "kind string, path string, n_entries long, size_bytes long, mtime_ns long, ctime_ns long, st_dev string, st_ino string"
_SCHEMA = pa.schema([("kind", pa.string()), ("path", pa.string()), ("n_entries", pa.int64()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("ctime_ns", pa.int64()), ("st_dev", pa.string()), ("st_ino", pa.string())])
#: Folders that one task lists, and files that one task reads.
FOLDERS, FILES = 64, 256


def _rows(config: dict, rel: str, skip: set[tuple[int, int]]) -> list[dict]:
    try:
        here = folder(config, rel, skip)
    except WalkError as e:
        return [{"kind": type(e).__name__, "path": f"{rel}\n{e}"}]
    rows = [{"kind": "listed", "path": rel, "n_entries": here.entries}]
    rows += [{"kind": "root", "path": r} for r in sorted(here.found)] + [{"kind": "folder", "path": p} for p in here.folders]
    return rows + [{"kind": "file", "path": r["relpath"]} | {k: r[k] for k in _STAT} for r in here.files]


def listing(spark: SparkSession, config: dict, skip: set[tuple[int, int]], to: str) -> DataFrame:
    """(relpath, size_bytes, mtime_ns, ctime_ns, st_dev, st_ino) of all regular files; levels are written below ``to``."""

    def run(batches):
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(_rows(config, rel, skip), _SCHEMA)

    frontier, n, entries, files, found, levels = spark.createDataFrame([("",)], "path string"), 1, 0, 0, set(), []
    path = f"{to}/listing-{uuid.uuid4().hex}"
    while n:
        at = f"{path}/{len(levels)}"
        frontier.repartition(1 + n // FOLDERS).mapInArrow(run, _KINDS).write.parquet(at)
        level = spark.read.schema(_KINDS).parquet(at)
        is_kind = lambda k: F.col("kind") == k
        faults = F.min(F.when(F.col("kind").isin("WalkError", "Changed"), F.struct("path", "kind")))
        sums = level.agg(F.coalesce(F.sum("n_entries"), F.lit(0)).alias("entries"), F.count(F.when(is_kind("file"), 1)).alias("files"), F.count(F.when(is_kind("folder"), 1)).alias("folders"), F.collect_set(F.when(is_kind("root"), F.col("path"))).alias("roots"), faults.alias("fault")).first()
        if sums.fault:
            raise {"Changed": Changed}.get(sums.fault.kind, WalkError)(sums.fault.path.partition("\n")[2])
        entries, files, n = entries + sums.entries, files + sums.files, sums.folders
        check_totals(config, entries, files)
        found |= set(sums.roots)
        levels.append(level)
        frontier = level.where(is_kind("folder")).select("path")
    check_roots(config, found)
    return reduce(DataFrame.unionByName, levels).where(F.col("kind") == "file").select(F.col("path").alias("relpath"), *_STAT)


def read_listed(files: DataFrame, options: dict) -> DataFrame:
    """The columns of the ``corpus`` source for listed files, each read once by a task."""
    reader = _Reader(options)
    names = CorpusSource.schema(None).replace(",", "").split()[::2]
    kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3, pa.binary()]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                class One:
                    value = [row]

                values = next(iter(reader.read(One)))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    return files.repartition(1 + files.count() // FILES, "relpath").mapInArrow(run, CorpusSource.schema(None))

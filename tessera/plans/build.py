"""Building an index: walk, reuse, extract, write, verify, publish.

Tasks list the tree, level by level, and read each file once, so the hash and the
text come from the same bytes.  What an earlier
snapshot knows of an unchanged file is taken over by a join on (path, hash); only
the rest is extracted.  A second walk at the end must find the same manifest.
"""

from __future__ import annotations

import datetime
import json
import os
import shutil
import threading
import time
import uuid
import warnings

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import nfc
from ..operators import checks
from ..operators import retrieval as R
from ..schema import CONTENT, EXTRACTORS, FILES, SCHEMA_VERSION, SOURCE_LIMITS
from ..sources.config import policy_digest
from ..sources.extract import Missing, extracted, probe
from ..sources.listing import listing, read_listed
from ..sources.walk import Changed, WalkError, corpus_marker
from . import publish
from .sqlguard import message
from .search import INDEXES, Tables, write_indexes
from .workspace import shared_folder


class BuildError(RuntimeError):
    """The build can't be published (exit code 1)."""


def own_folders(config: dict) -> set[tuple[int, int]]:
    """Device and inode of what a build itself writes to: the publication folder is no part of the corpus."""
    s = os.stat(config["publish_dir"])
    return {(s.st_dev, s.st_ino)}


def listed(spark: SparkSession, config: dict) -> DataFrame:
    return listing(spark, config, own_folders(config), shared_folder(spark))


def read_corpus(files: DataFrame, config: dict) -> DataFrame:
    limits = {ext: SOURCE_LIMITS[label] for label, group in EXTRACTORS.items() for ext in group}
    return read_listed(files, {"config": json.dumps(config), "limits": json.dumps(limits)})


def described(raw: DataFrame, config: dict) -> DataFrame:
    """Columns of ``files`` that follow from the manifest, and ``early``, the state of what isn't read."""
    name = F.col("filename_nfc")
    out = raw.withColumn("relpath_nfc", nfc(F.col("relpath"))).withColumn("filename", paths.filename(F.col("relpath"))).withColumn("filename_nfc", paths.filename(F.col("relpath_nfc")))
    out = out.withColumns({"ext": paths.extension(name), "area": paths.area(F.col("relpath_nfc")), "path_year": paths.path_year(F.col("relpath_nfc")), "name_meta": paths.name_meta(name, config["filename_pattern"]), "mtime": F.floor(F.col("mtime_ns") / F.lit(1_000_000_000)).cast("long")})
    return out.withColumn("early", paths.early_status(F.col("relpath_nfc"), F.col("ext"), F.col("size_bytes"), config["metadata_only_globs"]))


def files_read(config: dict):
    """Whether a row of the corpus has content that is read, and so a hash."""
    path = nfc(F.col("relpath"))
    return paths.early_status(path, paths.extension(paths.filename(path)), F.col("size_bytes"), config["metadata_only_globs"]).isNull()


def previous(spark: SparkSession, folder: str, meta_wanted: dict, config: dict) -> tuple[str, DataFrame, DataFrame] | None:
    """The snapshot in use with its tables, if its extractions may be taken over.

    A snapshot that is damaged, or larger than any that this configuration could have
    made, is passed over with a warning; all files are then extracted anew.
    """
    try:
        snapshot = publish.current(folder)
        if snapshot is None:
            return None
        meta = publish.read_meta(snapshot)
        if meta.get("schema_version") != SCHEMA_VERSION or any(meta.get(k) != meta_wanted[k] for k in ("corpus_uuid", "access_policy_id", "policy_digest")):
            return None
        if any(type(meta.get(k)) is not int or not 0 <= meta[k] <= config["max_total_files"] for k in ("file_count", "content_count")):
            raise publish.PublicationError("its counts are out of bounds")
        if sum(size for size, _ in publish.read_manifest(snapshot).values()) > config["max_index_size_mb"] << 20:
            raise publish.PublicationError("it exceeds max_index_size_mb")
        if faults := publish.faults(spark, snapshot):
            raise publish.PublicationError(faults[0])
        files, content = (spark.read.parquet(f"{snapshot}/{t}") for t in ("files", "content"))
        if (files.count(), content.count()) != (meta["file_count"], meta["content_count"]):
            raise publish.PublicationError("its counts differ from meta.json")
        return snapshot, files, content
    except (publish.PublicationError, OSError, ValueError, PySparkException, Py4JError) as e:
        warnings.warn(f"the previous index can't be reused, everything is extracted again: {message(e)}", stacklevel=2)
        return None


class Budgets:
    """Stops a build while it writes, once its text or its files exceed their budgets.

    Tasks add the bytes of the texts they have written to an accumulator when they
    end; the folder's size is looked up meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str, most_text: int, most_size: int, every: float = 0.2):
        self.spark, self.folder, self.most_text, self.most_size, self.every = spark, folder, most_text, most_size, every
        self.text, self.group, self.fault = spark.sparkContext.accumulator(0), f"build-{uuid.uuid4().hex}", ""
        self._end = threading.Event()

    def counted(self, df: DataFrame) -> DataFrame:
        """``df``, whose texts count as they are made."""
        spent = self.text

        @F.pandas_udf("long")
        def spend(sizes: pd.Series) -> pd.Series:
            spent.add(int(sizes.sum()))
            return sizes

        return df.where(spend(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")) >= 0)

    def size(self) -> int:
        total = 0
        for top, _, names in os.walk(self.folder):
            for n in names:
                try:
                    total += os.path.getsize(os.path.join(top, n))
                except OSError:
                    continue  # renamed meanwhile
        return total

    def _watch(self) -> None:
        while not self._end.wait(self.every):
            if self.text.value > self.most_text:
                self.fault = "the extracted text exceeds max_total_extracted_mb"
            elif self.size() > self.most_size:
                self.fault = "the index exceeds max_index_size_mb"
            if self.fault:
                self.spark.sparkContext.cancelJobGroup(self.group)

    def __enter__(self):
        self.spark.sparkContext.setJobGroup(self.group, "index build", interruptOnCancel=True)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace):
        self._end.set()
        self._thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.spark.sparkContext.setLocalProperty(name, None)
        if self.fault and error is not None:
            raise BuildError(self.fault) from error


def extract_all(raw: DataFrame, config: dict, cache: tuple[str, DataFrame, DataFrame] | None) -> DataFrame:
    """All columns of ``files`` and ``content`` side by side."""
    base = described(raw, config).withColumn("source_hash", F.when(F.col("early").isNull(), F.col("source_hash")))
    if cache:
        base = checks.reuse(base, *cache[1:]).withColumnRenamed("text", "old_text")
        bad = F.raise_error(F.lit("the cache is inconsistent")).cast("boolean")
        base = base.where(F.when(F.col("hit") & F.col("broken"), bad).otherwise(True))
    else:
        none = F.lit(None).cast("string")
        base = base.withColumns({"hit": F.lit(False), "old_status": none, "old_text": none})
    label = paths.extractor(F.col("ext"))
    todo = F.col("early").isNull() & ~F.col("hit")
    base = base.withColumn("new", extracted(F.when(todo, label), F.when(todo, F.col("data")), config["pdf_memory_limit_mb"])).drop("data")
    state = F.coalesce("early", "old_status", "new.state")
    text = F.coalesce("old_text", "new.text")
    out = base.withColumns({"content_status": state, "text": F.when((state == "extracted") & (text != ""), text), "extractor": label})
    return out.withColumns({"metadata_only": (F.col("content_status") == "metadata_only").cast("int"), "content_present": F.col("text").isNotNull().cast("int")})


def write_tables(spark: SparkSession, everything: DataFrame, to: str, previous: str | None = None) -> None:
    """``files`` and ``content``, sorted by path, then the indexes; what a previous snapshot has of them is taken over."""
    everything.write.parquet(f"{to}/work")
    work = spark.read.parquet(f"{to}/work")
    ordered = lambda df: df.repartitionByRange("relpath").sortWithinPartitions("relpath")
    ordered(work.select(*FILES.names)).write.parquet(f"{to}/files")
    ordered(work.where("text is not null").select("relpath", "text", "extractor", F.col("source_hash").alias("source_sig")).select(*CONTENT.names)).write.parquet(f"{to}/content")
    shutil.rmtree(f"{to}/work")
    write_indexes(spark, to, previous)


def build(spark: SparkSession, config: dict, keep_unpublished: bool = False) -> str:
    """Build and publish; the path of the new snapshot."""
    folder = config["publish_dir"]
    if not os.path.isdir(folder):
        raise BuildError("publish_dir does not exist")
    with publish.locked(folder):
        marker, digest = corpus_marker(config), policy_digest(config)
        want = publish.desired_binding(config, digest, marker[0])
        action = publish.decide(folder, want)
        if action == "advance" and (faults := publish.faults(spark, publish.current(folder))):
            raise publish.PublicationError(f"a higher generation needs an undamaged baseline: {faults[0]}")
        cache = previous(spark, folder, want, config)
        before = publish.current(folder)
        previous_count = (publish.read_meta(before)["file_count"], publish.read_meta(before)["policy_digest"]) if before else None
        snapshot = os.path.join(folder, f"snapshot-{uuid.uuid4().hex}")
        for attempt in range(config["max_walk_retries"] + 1):
            began = time.time()
            try:
                _attempt(spark, config, snapshot, want, cache, previous_count, began)
                break
            except Exception as e:
                shutil.rmtree(snapshot, ignore_errors=True)
                text = str(e) if isinstance(e, (BuildError, WalkError, Changed)) else message(e)
                if "cache is inconsistent" in f"{text} {e}" and cache:
                    cache = None
                elif not (isinstance(e, Changed) or "Changed" in f"{text} {e}") or attempt == config["max_walk_retries"]:
                    raise e if isinstance(e, (BuildError, WalkError)) else BuildError(text) from e
        else:
            raise BuildError("the tree kept changing")
        if corpus_marker(config) != marker:
            shutil.rmtree(snapshot)
            raise BuildError("the corpus marker changed")
        if not keep_unpublished:
            if faults := publish.faults(spark, snapshot):
                shutil.rmtree(snapshot)
                raise BuildError(f"the new index was damaged before it could be published: {faults[0]}")
            publish.publish(folder, snapshot, want, action)
            publish.retain(folder, {snapshot, before})
        return snapshot


def _probe(files: DataFrame) -> None:
    """What the corpus needs must work before anything, reused results included, is published."""
    ext = F.lower(F.substring_index("relpath", ".", -1))
    of = {e: label for label, group in EXTRACTORS.items() for e in group}
    try:
        probe({of[r[0]] for r in files.select(ext).distinct().where(ext.isin(list(of))).collect()})
    except Missing as e:
        raise BuildError(str(e)) from None


def _attempt(spark, config, snapshot, want, cache, previous_count, began) -> None:
    found = listed(spark, config)
    _probe(found)
    raw = read_corpus(found, config)
    with Budgets(spark, snapshot, config["max_total_extracted_mb"] << 20, config["max_index_size_mb"] << 20) as budgets:
        write_tables(spark, budgets.counted(extract_all(raw, config, cache)), snapshot, cache[0] if cache else None)
    files, content = (spark.read.parquet(f"{snapshot}/{t}") for t in ("files", "content"))
    # The second manifest, with hashes of all bytes read again, is compared by a join, not on the driver.
    seen = read_corpus(listed(spark, config), config).drop("data")
    stamps = ["size_bytes", "mtime_ns", "ctime_ns", "st_dev", "st_ino"]
    then = files.select("relpath", *stamps, F.coalesce("source_hash", F.lit("")).alias("source_hash"))
    read = F.coalesce(F.when(files_read(config), F.col("source_hash")), F.lit(""))
    if not checks.manifest_diff(then, seen.select("relpath", *stamps, read.alias("source_hash")), [*stamps, "source_hash"]).isEmpty():
        raise Changed("the tree changed during the build")
    walked = files.count()
    smoke = None
    if config["smoke_term"] is not None:
        phrase = [t for p in R.phrases(config["smoke_term"]) for t in p]
        smoke = tuple(R.lookup(Tables(spark, snapshot).postings(i), None, [phrase]).where("f0 > 0").count() if phrase else 0 for i in INDEXES)
    problems = checks.verify(files, content, walked, config, previous_count, want["policy_digest"], smoke)
    size = sum(os.path.getsize(os.path.join(top, f)) for top, _, fs in os.walk(snapshot) for f in fs)
    if size > config["max_index_size_mb"] << 20:
        problems.append("the index exceeds max_index_size_mb")
    if problems:
        raise BuildError("; ".join(problems))
    meta = {k: want[k] for k in ("corpus_uuid", "access_policy_id", "access_policy_generation", "policy_digest")} | {
        "schema_version": SCHEMA_VERSION, "tool_version": "1", "corpus_root": config["corpus_root"], "access_roots": config["access_roots"], "excluded_access_count": 0,
        "generated_at": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "elapsed_seconds": round(time.time() - began, 3),
        "file_count": files.count(), "content_count": content.count(), "content_status_breakdown": {r[0]: r[1] for r in checks.status_breakdown(files).orderBy("content_status").collect()},
    }
    if missing := [k for k, v in meta.items() if v is None]:
        raise BuildError(f"meta has no {', '.join(missing)}")
    with open(f"{snapshot}/meta.json", "w") as f:
        json.dump(meta, f, indent=2)
    publish.write_manifest(spark, snapshot)

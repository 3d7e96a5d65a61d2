"""Reuse of earlier extractions, manifest comparison, and build verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import below_pruned
from ..schema import REUSABLE


def reuse(manifest: DataFrame, files: DataFrame, content: DataFrame) -> DataFrame:
    """The manifest (relpath, source_hash, ...) with what an earlier index knows: hit, status, text, extractor.

    A hit has the same path and hash and a reusable state.  An extracted file may
    lack a content row only if it had no text; else the cache is ``broken``.
    """
    old = files.where(F.col("content_status").isin(REUSABLE) & F.col("source_hash").isNotNull()).join(content.select("relpath", "text", "extractor", "source_sig"), "relpath", "left")
    broken = F.coalesce(F.col("source_sig") != F.col("source_hash"), F.lit(False)) | ((F.col("content_present") == 1) != F.col("source_sig").isNotNull())
    old = old.select(F.col("relpath").alias("old_path"), F.col("source_hash").alias("old_hash"), F.col("content_status").alias("old_status"), "text", "extractor", broken.alias("broken"))
    # The hash is no key of the join but a condition: texts, dealt by path above, need not be dealt again.
    same = F.when(F.col("source_hash") == F.col("old_hash"), True).otherwise(False)
    joined = manifest.join(old, (F.col("relpath") == F.col("old_path")) & same, "left").drop("old_path", "old_hash")
    return joined.withColumn("hit", F.col("old_status").isNotNull())


def manifest_diff(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(relpath, change) of files that were added, removed or changed between two walks."""
    a = before.select("relpath", F.struct(*columns).alias("x"))
    b = after.select("relpath", F.struct(*columns).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return a.join(b, "relpath", "full").select("relpath", change.alias("change")).where("change is not null")


def orphans(content: DataFrame, files: DataFrame) -> DataFrame:
    """Content without its file."""
    return content.join(files.select("relpath"), "relpath", "left_anti")


def status_breakdown(files: DataFrame) -> DataFrame:
    return files.groupBy("content_status").agg(F.count("*").alias("n_files"))


def breakdown_json(files: DataFrame) -> DataFrame:
    """One row: a JSON object from state to count, keys sorted."""
    pairs = F.sort_array(F.collect_list(F.struct("content_status", "n_files")))
    return status_breakdown(files).agg(F.to_json(F.map_from_entries(pairs)).alias("breakdown"))


def extracted_bytes(content: DataFrame) -> DataFrame:
    return content.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("extracted_bytes"))


def prune_leaks(files: DataFrame, names: list[str]) -> DataFrame:
    """(name, n_leaked) of files below a folder that should have been left out."""
    return files.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), below_pruned(F.col("relpath_nfc"), [n]).cast("long").alias("leaked")) for n in names])).alias("x")).groupBy("x.name").agg(F.sum("x.leaked").alias("n_leaked"))


def dropped_too_far(now: Column, before: Column, fraction: float) -> Column:
    return now < before * F.lit(1.0 - fraction)


def verify(files: DataFrame, content: DataFrame, expected_files: int, config: dict, previous: tuple[int, str] | None = None, digest: str | None = None, smoke: tuple[int, int] | None = None) -> list[str]:
    """All reasons against publishing an index; empty if there is none."""
    r = files.agg(F.count("*").alias("n"), F.count_distinct("relpath").alias("u"), *[F.sum(below_pruned(F.col("relpath_nfc"), [n]).cast("long")).alias(f"p{i}") for i, n in enumerate(config["prune_dirs"])]).first()
    size = extracted_bytes(content).first()[0]
    problems = []
    if r.n != r.u:
        problems.append("paths are not unique")
    if r.n != expected_files:
        problems.append(f"{r.n} files are indexed, {expected_files} were walked")
    if not r.n and not config["allow_empty"]:
        problems.append("the index is empty")
    if r.n < config["min_file_count"]:
        problems.append(f"{r.n} files are fewer than min_file_count {config['min_file_count']}")
    if size > config["max_total_extracted_mb"] << 20:
        problems.append("the extracted text exceeds max_total_extracted_mb")
    if not orphans(content, files).isEmpty():
        problems.append("content without its file")
    if previous and previous[1] == digest and r.n < previous[0] * (1.0 - config["max_file_count_drop_fraction"]):
        problems.append(f"the number of files dropped from {previous[0]} to {r.n}")
    problems += [f"{r[f'p{i}']} files are below a pruned folder {n!r}" for i, n in enumerate(config["prune_dirs"]) if r[f"p{i}"]]
    if smoke is not None:
        problems += [f"the smoke term has no hit in {kind}" for kind, n in zip(("names", "content"), smoke, strict=True) if n <= 0]
    return problems

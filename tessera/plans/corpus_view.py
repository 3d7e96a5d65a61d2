"""``files`` and ``content`` tables derived from a ``documents`` table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import collapse_blanks, let
from ..schema import MAX_TEXT
from .search import Tables, write_indexes
from .workspace import shared_folder, stored

#: Extension of a document by its id modulo their number; empty is none.
EXTENSIONS = ["txt", "md", "csv", "html", "doc", "bin", "pdf", ""]
GLOBS = ["src1/*"]
NAME_PATTERN = r"(?P<lang>[a-z]{2})-(?P<num>[0-9]+)"


def read_files(docs: DataFrame, globs: list[str] = GLOBS) -> DataFrame:
    """One file per document, named by source, year, language and id, with its state; ``body`` is the text of those with content."""
    number = F.col("doc_id").cast("string")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), F.pmod("doc_id", F.lit(len(EXTENSIONS))).cast("int"))
    relpath = F.concat("source", F.lit("/"), (2015 + F.pmod("doc_id", F.lit(12))).cast("string"), F.lit("/"), "lang", F.lit("-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    size = F.octet_length("text").cast("long")

    # Values are bound by ``let``: pushing the filter on states down would otherwise put
    # copies of the path expression into every place where it is used.  Paths, early states
    # and late ones are apart, so that what needs only paths doesn't read texts, and what
    # needs only hashes doesn't collapse them.
    def named(path):
        return let(paths.filename(path), lambda name: F.struct(path.alias("relpath"), name.alias("filename"), paths.extension(name).alias("ext")))

    def late(body):
        status = F.when(F.octet_length(body) > MAX_TEXT, "too_big").when((F.col("ext") == "pdf") & (body == ""), "empty_pdf").otherwise("extracted")
        return let(status, lambda s: let((s == "extracted") & (body != ""), lambda full: F.struct(s.alias("content_status"), full.alias("full"), F.when(full, body).alias("body"))))

    base = docs.select(let(relpath, named).alias("p"), "text", size.alias("size_bytes"), (1_700_000_000 + F.col("doc_id")).alias("mtime")).select("p.*", "text", "size_bytes", "mtime")
    base = base.withColumn("early", let(F.struct("relpath", "ext", "size_bytes"), lambda p: paths.early_status(p["relpath"], p["ext"], p["size_bytes"], globs)))
    unread = F.struct(F.col("early").alias("content_status"), F.lit(False).alias("full"), F.lit(None).cast("string").alias("body"))
    base = base.withColumn("d", F.when(F.col("early").isNull(), let(collapse_blanks(F.col("text")), late)).otherwise(unread))
    return base.select("relpath", "filename", "ext", "size_bytes", "mtime", F.when(F.col("early").isNull(), F.sha2("text", 256)).alias("source_hash"), "d.*")


def split(read: DataFrame, pattern: str | None = NAME_PATTERN) -> tuple[DataFrame, DataFrame]:
    """``files`` and ``content`` of ``read_files``."""
    files = read.select(
        "relpath", F.col("relpath").alias("relpath_nfc"), "filename", F.col("filename").alias("filename_nfc"), paths.area(F.col("relpath")).alias("area"), "ext", "size_bytes", "mtime",
        "source_hash",
        paths.path_year(F.col("relpath")).alias("path_year"),
        paths.name_meta(F.col("filename"), pattern).alias("name_meta"),
        (F.col("content_status") == "metadata_only").cast("int").alias("metadata_only"),
        F.col("full").cast("int").alias("content_present"),
        "content_status",
    )
    content = read.where("full").select("relpath", F.col("body").alias("text"), paths.extractor(F.col("ext")).alias("extractor"), F.col("source_hash").alias("source_sig"))
    return files, content


def files_and_content(docs: DataFrame, globs: list[str] = GLOBS, pattern: str | None = NAME_PATTERN) -> tuple[DataFrame, DataFrame]:
    return split(read_files(docs, globs), pattern)


def written(spark: SparkSession, sf_dir: str, again: bool = False) -> Tables:
    """Both tables with their indexes, written once for each application and folder (``again``: anew)."""
    key = spark.sparkContext.applicationId, sf_dir
    if again or key not in _written:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        # Texts are read once, and columns made after rows are dealt: that looks at what it deals twice.
        read = stored(read_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
        for name, df in zip(("files", "content"), split(read.repartitionByRange("relpath")), strict=True):
            df.sortWithinPartitions("relpath").write.parquet(f"{path}/{name}")
        write_indexes(spark, path)
        _written[key] = path
    return Tables(spark, _written[key])


_written: dict[tuple[str, str], str] = {}


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return files_and_content(spark.read.parquet(f"{sf_dir}/documents.parquet"))

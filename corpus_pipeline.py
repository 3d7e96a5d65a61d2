"""A training corpus from ``documents``, in five stages that each call one operator.

Every stage but the last returns the columns of documents (doc_id, text, lang,
source, n_chars); the last returns packed pieces.  A stage's result is written
as Parquet and read again as the next one's input.

Defined cases: a null, empty or blank text has no language, so its row goes in the
first stage; a text that loses all its lines or words stays as an empty one, and is
packed as its end token; rows that share a doc_id are judged each by its own text,
and one row of a group of near copies stays, of those with the smallest doc_id; null
lang or source stays null; an empty table gives no rows in any stage; further columns
of the table are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, near_dedup, packing, substring_dedup
from tessera.llm.common import durable, partitions, scratch, shared_dir, small
from tessera.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected as of no language if its best language has less than this share.
LEAST_SCORE = 0.4


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the others stay as they are."""
    network = language_id.fit(docs)
    seen = language_id.predict(docs, network, keep=COLUMNS[1:])
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_dedup.line_dedup(docs.select(*COLUMNS)), F.col("text"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Ids that name several rows don't tell which one goes: number the rows, in the order of ids.
        order = ["doc_id", "text", "lang", "source"]
        docs = docs.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        docs = durable(docs.withColumn("__row", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("__row", F.col("doc_id"))
    gone = near_dedup.near_dedup(docs, size=5, percent=80, id_col="__row").where("not kept").select(F.col("doc_id").alias("__row"))
    return docs.join(small(gone), "__row", "left_anti").select(*COLUMNS)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; what is between the other words stays as it is."""
    return _with_text(substring_dedup.substring_dedup(docs, window=50, keep=COLUMNS), F.coalesce("cut_text", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, capacity=4096, with_ids=False).drop("piece")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_lines),
    ("MinHash near-dedup", remove_near_copies),
    ("substring dedup", remove_passages),
    ("packing", pack),
]

#: Language ID is a trained network, so no SQL gives these rows; tests/llm has a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

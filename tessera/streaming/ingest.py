"""Structured Streaming ingest: new document files become postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import collapse_blanks
from ..operators import retrieval as R


def ingest(spark: SparkSession, source: str, schema: StructType, to: str, key: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Append postings and lengths of the Parquet files in ``source``, each file once.

    Every batch writes to a folder named by its number, and replaces it if the
    batch is tried again, so a restart neither loses nor repeats rows.
    """
    docs = spark.readStream.schema(schema).parquet(source).select(F.col(key).alias("relpath"), collapse_blanks(F.col(text)).alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        R.postings(batch, ["text"]).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{to}/postings/batch={number}")
        R.lengths(batch, ["text"]).write.mode("overwrite").parquet(f"{to}/lengths/batch={number}")
        batch.unpersist()

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", f"{to}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, as in tests, a folder of this process is taken;
    on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.applicationId not in _made:
        _made[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _made[spark.sparkContext.applicationId]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for what is used twice."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_made: dict[str, str] = {}

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Tables that ``durable`` wrote.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is missing, as in tests, a folder of this process is set; on
    a cluster that is an error, since executors couldn't see it.
    """
    context = spark.sparkContext._jsc.sc()
    there = context.getCheckpointDir()
    if there.isDefined():
        return there.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(path)
    return context.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again.

    This cuts the lineage, so a lost executor costs only the tasks it ran, and
    work whose result is used twice is done once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Delete at the end the tables that ``durable`` wrote meanwhile; what depends on them must be written by then."""
    before = len(_written)
    try:
        yield
    finally:
        jvm, context = spark._jvm, spark._jsc.hadoopConfiguration()
        while len(_written) > before:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(context).delete(path, True)


def releasing(run):
    """``run(batches)``, which gives freed memory back to the system when a task ends.

    Python workers outlive their tasks, and allocators keep what is freed: without
    this a worker holds the peak of all operators that it ever served.
    """

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Tables of ids or digests up to this number of rows (at most 16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; it is written first, so counting is cheap."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= most else df


def attach_by_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, hot_share: int = 256) -> DataFrame:
    """Inner join of ``rows`` to one row per ``key``, safe for groups of any size.

    ``groups[size]`` is the number of ``rows`` with that key.  Groups that hold
    more than one ``hot_share``-th of all rows are fewer than ``hot_share``, so
    they may be broadcast; the rest is joined by shuffle.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(1, total // hot_share)
    hot = groups.where(F.col(size) > limit)
    rest = groups.where(F.col(size) <= limit)
    keys = [key] if isinstance(key, str) else key
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(rest, key)
    return near.unionByName(far)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a string column, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component).

    ``component`` is the smallest node that can be reached.  Alternates the
    large-star and small-star steps until nothing changes; every step is a
    partial aggregation and a join to one row per node, which is broadcast up to
    ``BROADCAST_ROWS`` and beyond that joined by ``attach_by_group``, so a hub of any
    degree is spread over tasks.  Each step's edges are written to the shared
    folder.  Self-loops are ignored, and nodes without another neighbour are not
    returned.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    e = durable(e)
    state = None

    def with_least(rows: DataFrame, of: DataFrame, key: str, few: bool) -> DataFrame:
        least = of.groupBy(key).agg(F.min("w").alias("m"), F.count("*").alias("degree"))
        return rows.join(F.broadcast(least), key) if few else attach_by_group(rows, durable(least), key, "degree")

    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == state:
            break
        state, few = (n, mark), 2 * n <= BROADCAST_ROWS
        both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "w")
        large = with_least(both, both, "u", few).where("w > u").select(F.col("w").alias("u"), F.least("u", "m").alias("w")).distinct()
        if not few:
            large = durable(large)
        small = (
            with_least(large, large, "u", few)
            .select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("w").alias("hi"), F.col("m").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo")
            .where("hi <> lo")
            .distinct()
        )
        e = durable(small)
    members = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.union(roots)

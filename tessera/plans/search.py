"""The combined search: names and content, fused, with details and snippets of the hits.

An index holds, below the folder of its tables and for each of ``INDEXES``:

* ``postings``: one row a term of a document with its positions and the document's
  length, and one a document without term, in segments; each file holds whole documents, in runs sorted by term, so a
  term's pages are found by their bounds and nothing is shuffled to write them; a
  rebuild adds a segment of what changed and keeps the older ones;
* ``gone``: which documents' postings up to a segment no longer count;
* ``terms``: every term's documents and occurrences, ``stats``: those of the index;
* ``lengths``: tokens of every document, which a rebuild needs and no query reads.
"""

from __future__ import annotations

import glob
import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import retrieval as R
from ..operators.snippet import snippet
from ..schema import HIT_COLUMNS
from .workspace import stored

#: What each index is made from: a table, its columns, and what tells whether a row's tokens are still the same.
INDEXES = {"names": ("files", ["filename_nfc", "relpath_nfc"]), "content": ("content", ["text"])}
_SAME = {"names": "relpath_nfc", "content": "source_sig"}
#: Rows of postings but for those that hold lengths.
_TERM = "term IS NOT NULL"
PARTS = ("postings", "gone", "terms", "stats", "lengths")
#: A rebuild merges segments when there are this many, or when more than this share of the documents has changed since the last merge.
MOST_SEGMENTS, MOST_CHANGED = 8, 0.25
#: Changed documents up to this number (a path each) are broadcast.
_BROADCAST = 500_000


def hit_limit(n: int) -> int:
    if not 1 <= n <= 1000:
        raise R.QueryError("limit must be from 1 to 1000")
    return n


def _write_postings(rows: DataFrame, path: str) -> DataFrame:
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _without(df: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    return df.join(F.broadcast(paths) if n <= _BROADCAST else paths, "relpath", "left_anti")


def write_indexes(spark: SparkSession, path: str, previous: str | None = None) -> None:
    """The indexes of the tables under ``path``; with ``previous``, a snapshot, only what differs from it is tokenised."""
    for index in INDEXES:
        old = Tables(spark, previous) if previous else None
        if old is None or not _write_segment(spark, path, old, index):
            _write_whole(spark, path, index)


def _write_whole(spark: SparkSession, path: str, index: str) -> None:
    table, columns = INDEXES[index]
    rows = _write_postings(R.indexed(spark.read.parquet(f"{path}/{table}"), columns), f"{path}/{index}_postings/segment=0")
    R.sizes(rows).write.parquet(f"{path}/{index}_lengths")
    _finish(spark, path, index, R.term_stats(rows.where(_TERM), len(columns)), None)


def _finish(spark: SparkSession, path: str, index: str, terms: DataFrame, gone: DataFrame | None) -> None:
    none = spark.createDataFrame([], "relpath string, upto int")
    (none if gone is None else gone).write.parquet(f"{path}/{index}_gone")
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{index}_terms")
    n_gone = spark.read.parquet(f"{path}/{index}_gone").count()
    sizes = spark.read.parquet(f"{path}/{index}_lengths")
    sizes.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn("n_gone", F.lit(n_gone)).coalesce(1).write.parquet(f"{path}/{index}_stats")


def _write_segment(spark: SparkSession, path: str, old: Tables, index: str) -> bool:
    """Whether the index could be made from the previous one: linked segments and one of what changed, or all merged."""
    table, columns = INDEXES[index]
    now, then = (t.select("relpath", F.col(_SAME[index]).alias("mark")) for t in (spark.read.parquet(f"{path}/{table}"), old.table(table)))
    dead = stored(then.join(now, ["relpath", "mark"], "left_anti").select("relpath"))
    fresh = stored(now.join(then, ["relpath", "mark"], "left_anti").select("relpath"))
    n_dead, n_fresh, stats = dead.count(), fresh.count(), old.stats(index)
    segments = sorted(glob.glob(f"{old.path}/{index}_postings/segment=*"), key=lambda s: int(s.rpartition("=")[2]))
    if not segments or n_fresh > stats.n_rows:
        return False
    some = spark.read.parquet(f"{path}/{table}").join(F.broadcast(fresh) if n_fresh <= _BROADCAST else fresh, "relpath", "left_semi")
    merge, last = len(segments) >= MOST_SEGMENTS or stats.n_gone + n_dead + n_fresh > MOST_CHANGED * stats.n_rows, int(segments[-1].rpartition("=")[2])
    added = R.indexed(some, columns)
    added = stored(added) if merge else _write_postings(added, f"{path}/{index}_postings/segment={last + 1}")
    _without(old.table(f"{index}_lengths"), dead, n_dead).unionByName(R.sizes(added)).write.parquet(f"{path}/{index}_lengths")
    added, live = added.where(_TERM), old.rows(index)
    if merge:
        whole = _without(live, dead, n_dead).unionByName(added).repartition("relpath").sortWithinPartitions("term", "relpath")
        _finish(spark, path, index, R.term_stats(_write_postings(whole, f"{path}/{index}_postings/segment=0"), len(columns)), None)
        return True
    for s in segments:
        os.makedirs(to := f"{path}/{index}_postings/{os.path.basename(s)}")
        for f in os.listdir(s):
            if f.endswith(".parquet"):
                os.link(f"{s}/{f}", f"{to}/{f}")
    gone = old.table(f"{index}_gone").unionByName(dead.withColumn("upto", F.lit(last))).groupBy("relpath").agg(F.max("upto").alias("upto"))
    lost = R.term_stats(live.join(F.broadcast(dead) if n_dead <= _BROADCAST else dead, "relpath", "left_semi"), len(columns))
    change = R.term_stats(added, len(columns)).unionByName(lost.select("term", (-F.col("n_docs")).alias("n_docs"), (-F.col("n_total")).alias("n_total")))
    terms = old.table(f"{index}_terms").unionByName(change).groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_total").alias("n_total")).where("n_docs > 0")
    _finish(spark, path, index, terms, gone)
    return True


class Tables:
    """The tables ``files`` and ``content`` under one folder, with their indexes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._stats: dict = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stats(self, index: str):
        """(n_rows, n_tokens, n_gone) of an index, read once."""
        if index not in self._stats:
            self._stats[index] = self.table(f"{index}_stats").first()
        return self._stats[index]

    def rows(self, index: str) -> DataFrame:
        """(relpath, n_tokens, term, p0, ...) of the postings that count, as they are written."""
        post, n = self.table(f"{index}_postings").where(_TERM), self.stats(index).n_gone
        if n:
            gone = self.table(f"{index}_gone").withColumnRenamed("relpath", "lost")
            post = post.join(F.broadcast(gone) if n <= _BROADCAST else gone, (F.col("relpath") == F.col("lost")) & (F.col("segment") <= F.col("upto")), "left_anti")
        return post.select("relpath", "n_tokens", "term", *[f"p{i}" for i in range(len(INDEXES[index][1]))])

    def postings(self, index: str) -> DataFrame:
        """(relpath, col, pos, term, n_tokens) of the postings that count, one row a token."""
        return R.ungrouped(self.rows(index), len(INDEXES[index][1]))

    def found(self, index: str, query: list[list[str]]) -> DataFrame:
        """(relpath, n_tokens, f0, ...): only the query's terms are read."""
        return R.lookup_rows(self.rows(index), len(INDEXES[index][1]), query)

    def scores(self, index: str, query: list[list[str]]) -> DataFrame:
        """(relpath, score) of all documents that match; the documents of single words come from the term dictionary."""
        found, stats = self.found(index, query), self.stats(index)
        words = [p[0] for p in query if len(p) == 1]
        known = {r.term: r.n_docs for r in self.table(f"{index}_terms").where(F.col("term").isin(words)).collect()} if words else {}
        longer = [k for k, p in enumerate(query) if len(p) > 1]
        counted = found.agg(*[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"f{k}") for k in longer]).first() if longer else {}
        hits = tuple(counted[f"f{k}"] if k in longer else known.get(p[0], 0) for k, p in enumerate(query))
        return R.matched(found, R.Stats(stats.n_rows, stats.n_tokens, hits), len(query))

    def matches(self, index: str, text: str) -> DataFrame:
        """(relpath, score) of all documents that a match expression finds."""
        node = M.parse(text, INDEXES[index][1])
        if node is None:
            return self.table("files").select("relpath", F.lit(0.0).alias("score")).limit(0)
        counts, stats, n = stored(M.counts(self.postings(index), node)), self.stats(index), sum(1 for _ in node.phrases())
        hits = counts.agg(*[F.count(F.when(F.col(f"d{k}") > 0, 1)) for k in range(n)]).first()
        found = counts.where(M.condition(node)[0]).select("relpath", "n_tokens", *[c.alias(f"f{k}") for k, c in enumerate(M.counted(node))])
        return found.select("relpath", R.bm25(R.Stats(stats.n_rows, stats.n_tokens, tuple(hits)), n).alias("score"))

    def ranks(self, index: str, query: list[list[str]], keep: Column | None, limit: int | None) -> DataFrame:
        """Ranked (relpath, score) of the files that pass the filter."""
        if not query:
            return self.table("files").select("relpath", F.lit(0.0).alias("score")).limit(0)
        return R.ranked(self.scores(index, query), self.table("files"), keep, limit)

    def _among(self, name: str, paths: list[str]) -> DataFrame:
        """The rows of these paths; tables are sorted by path, so few row groups are read."""
        return self.table(name).where(F.col("relpath").isin(paths) if paths else F.lit(False))

    @contextmanager
    def _held(self, *frames: DataFrame):
        held = [f.persist() for f in frames]
        try:
            yield held
        finally:
            for f in held:
                f.unpersist()

    def names(self, terms: str, limit: int = 20, **filters) -> DataFrame:
        """Hits among names, best first."""
        rows = self.ranks("names", R.phrases(terms), R.file_filter(**filters), hit_limit(limit)).collect()
        top = F.broadcast(self.spark.createDataFrame(rows, "relpath string, score double"))
        out = top.join(self._among("files", [r.relpath for r in rows]), "relpath")
        return out.select(*HIT_COLUMNS, F.lit("name").alias("matched_by"), F.lit(None).cast("string").alias("snippet"), "score").orderBy("score", "relpath")

    def search(self, terms: str, limit: int = 20, snippets: bool = True, **filters) -> DataFrame:
        """At most ``limit`` hits, best first.

        Ranking works on (relpath, score) alone; details are joined, and snippets
        made, for the final hits.  Their number is bounded by the limit, so they are
        broadcast.  A hit whose details are missing fails the job, as does one
        without its text if snippets are made.
        """
        query, keep = R.phrases(terms), R.file_filter(**filters)
        hit_limit(limit)
        with self._held(*[self.ranks(i, query, keep, R.MAX_CANDIDATES + 1) for i in INDEXES]) as sources:
            R.check_candidates(*sources)
            rows = R.fuse(*sources, limit).collect()
        top, paths = F.broadcast(self.spark.createDataFrame(rows, "relpath string, score double, matched_by string")), [r.relpath for r in rows]
        out = self._sure(top.join(self._among("files", paths).select(*HIT_COLUMNS, F.lit(True).alias("there")), "relpath", "left"), "there", "no details of")
        if snippets:
            texts = self._among("content", [r.relpath for r in rows if r.matched_by != "name"])
            out = out.join(texts.select("relpath", snippet(F.col("text"), query).alias("snippet")), "relpath", "left")
            out = self._sure(out.withColumn("told", (F.col("matched_by") == "name") | F.col("snippet").isNotNull()), "told", "no text of")
        return out.orderBy(F.desc("score"), "relpath").select(*HIT_COLUMNS, "matched_by", "score", *["snippet"] * snippets)

    @staticmethod
    def _sure(df: DataFrame, flag: str, fault: str) -> DataFrame:
        bad = F.raise_error(F.concat(F.lit(f"the index is damaged: {fault} "), F.col("relpath"))).cast("boolean")
        return df.where(F.when(F.coalesce(flag, F.lit(False)), True).otherwise(bad)).drop(flag)

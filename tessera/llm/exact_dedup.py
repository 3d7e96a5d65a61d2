"""Exact deduplication through a cuckoo-filter index of live digests.

The index is sharded by digest.  Each shard is a cuckoo filter (16-bit
fingerprints, four to a bucket, partial-key displacement) beside the bucketed
content that it guards: for every bucket pair, the whole keys stored under it.
A filter miss proves a digest new; a hit is verified against the content.  When
an insertion finds no free place, the table doubles and is refilled from the
stored keys.  Documents can be withdrawn: each takes one off its digest's members,
and a digest that is left without members is deleted from filter and content.

Defined cases: null text counts as empty, and texts that are empty or blank are
copies of each other; of equal texts the one with the most code points stays,
then the one with the smallest doc_id; repeated rows of one doc_id are members
like any other; a null doc_id comes after all others, and no withdrawal meets it;
an empty table gives no rows; other columns are ignored.  doc_id must be a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach_by_group, durable, partitions

_SLOTS, _KICKS = 4, 500
#: Rows of a shard, about, at some 400 bytes each.
_SHARD_ROWS = 250_000


class CuckooIndex:
    """A cuckoo filter over 128-bit-or-longer keys, with the keys and a value for each."""

    def __init__(self, buckets: int = 64):
        self._seed = np.random.default_rng(7)
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.buckets = buckets
        self.table = np.zeros((buckets, _SLOTS), np.uint16)
        self.content: dict[tuple[int, int], dict[bytes, object]] = {}
        self.live = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        i = int.from_bytes(key[8:16], "little") & (self.buckets - 1)
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return (i ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def maybe(self, key: bytes) -> bool:
        """False proves that the key is absent."""
        mark, i, j = self._places(key)
        return bool((self.table[i] == mark).any() or (self.table[j] == mark).any())

    def get(self, key: bytes):
        """The value of a live key, or None; the filter first, then the content."""
        if not self.maybe(key):
            return None
        _, i, j = self._places(key)
        return self.content.get((min(i, j), max(i, j)), {}).get(key)

    def set(self, key: bytes, value) -> None:
        """Insert the key, or give it another value."""
        mark, i, j = self._places(key)
        bucket = self.content.setdefault((min(i, j), max(i, j)), {})
        if key in bucket:
            bucket[key] = value
            return
        bucket[key] = value
        self.live += 1
        if not self._place(mark, i, j):
            self._grow()

    def _place(self, mark: int, i: int, j: int) -> bool:
        for b in (i, j):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        b = i
        for _ in range(_KICKS):
            s = int(self._seed.integers(_SLOTS))
            mark, self.table[b, s] = int(self.table[b, s]), mark
            b = self._other(b, mark)
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        return False

    def _grow(self) -> None:
        """Double the table and refill it from the stored keys."""
        kept, buckets = [x for b in self.content.values() for x in b.items()], self.buckets
        while True:
            buckets *= 2
            self._reset(buckets)
            if all(self._insert_new(*x) for x in kept):
                return

    def _insert_new(self, key: bytes, value) -> bool:
        mark, i, j = self._places(key)
        self.content.setdefault((min(i, j), max(i, j)), {})[key] = value
        self.live += 1
        return self._place(mark, i, j)

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if there was none."""
        if self.get(key) is None:
            return False
        mark, i, j = self._places(key)
        pair = (min(i, j), max(i, j))
        del self.content[pair][key]
        if not self.content[pair]:
            del self.content[pair]
        b = i if (self.table[i] == mark).any() else j
        self.table[b, np.flatnonzero(self.table[b] == mark)[0]] = 0
        self.live -= 1
        return True

    def items(self):
        for bucket in self.content.values():
            yield from bucket.items()


_ROWS = "digest binary, n long, best_len long, best_id long"


def _merge(batches):
    """Fold rows (digest, n, best_len, best_id) into an index; digests left without members are deleted.

    Withdrawn documents count 1 and then -1, and have no best_len.
    """
    index = CuckooIndex()
    for batch in batches:
        for key, n, length, doc in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            have = index.get(key)
            if have is None:
                index.set(key, (n, length, doc))
            else:
                a, b = (have[1], have[2]), (length, doc)
                best = max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, -(x[1] or 0)))
                index.set(key, (have[0] + n, *best))
    for key in [k for k, v in index.items() if v[0] == 0]:
        index.delete(key)
    rows = [(k, *v) for k, v in index.items()]
    for i in range(0, len(rows), 10_000):
        cols = list(zip(*rows[i : i + 10_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["digest", "n", "best_len", "best_id"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars): SHA-256 of the text without ``SPACE`` characters, and its code points with them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256)).alias("digest"), F.length(text).cast("long").alias("len"))


def groups(marks: DataFrame, gone: str | None = None) -> DataFrame:
    """One row per live digest: (digest, n, best_len, best_id), through the index.

    Each task first folds its own rows, so a digest reaches a shard at most once
    from each task, whatever its number of copies.  ``gone`` names a column that is
    true for withdrawn documents.
    """
    rows = marks.select("digest", F.lit(1).cast("long").alias("n"), F.col("len").alias("best_len"), F.col("doc_id").alias("best_id"))
    if gone:
        left = F.when(~F.col(gone), F.col("len")), F.when(~F.col(gone), F.col("doc_id"))
        steps = F.when(F.col(gone), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1))).cast("array<long>")
        rows = marks.select("digest", F.explode(steps).alias("n"), left[0].alias("best_len"), left[1].alias("best_id"))
    shards = max(partitions(marks.sparkSession), 1 + marks.count() // _SHARD_ROWS)
    return rows.mapInArrow(_merge, _ROWS).repartition(shards, "digest").mapInArrow(_merge, _ROWS)


def exact_dedup(docs: DataFrame, withdrawn: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    ``withdrawn`` (doc_id) lists documents to delete from the index again: they
    take no part, and a digest without live members goes.
    """
    marks = digests(docs, id_col, text_col)
    if withdrawn is None:
        marks = durable(marks)
        found = durable(groups(marks))
    else:
        ids = withdrawn.select(F.col(id_col).alias("doc_id"), F.lit(True).alias("gone")).distinct()
        marks = durable(marks.join(ids, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
        found = durable(groups(marks, "gone"))
        marks = marks.where(~F.col("gone"))
    out = attach_by_group(marks, found, "digest", "n")
    return out.select(
        "doc_id",
        F.col("best_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("best_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

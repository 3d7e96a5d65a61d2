"""Hard negatives by bit-sliced integer products.

Vectors become whole numbers, floor(scale * x).  A block's vectors are cut into
bit-planes (two's complement), and a query's scores against the block are summed
plane by plane, most significant first.  What the planes still to come can add is
bounded by the query alone: with r = 2**k - 1 for k of them, it lies between r times
the sum of its negative components and r times that of its positive ones.  So after
each plane every score is known to lie in an interval, and a candidate goes once
its interval shows that it can't qualify:

* as a positive, when ``positives`` others surely score more;
* as a negative, when its interval misses every wanted range of scores, or when
  ``negatives`` others surely lie in that range and above it.

The first planes are matrix products of a block of queries and a block of rows; once
few candidates remain, the other planes are summed for these pairs alone.  All sums
are exact: doubles while they hold every value, 64-bit integers beyond; scores that
could exceed 2**56 raise an error.

Queries are dealt to blocks of about ``query_block`` by a hash, rows are packed into
blocks of ``row_block`` where they are read; each query block meets each row block in
one task, which returns a few rows for each query.  Nothing is broadcast unless the
planner finds it small, and a frequent label changes nothing: it isn't a key.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part; shorter vectors are filled up with zeros; rows that share an
id are separate rows, but none is another's positive; equal query rows count once,
and different query rows with one id give their own results; an empty table, or one
without queries, gives no rows; a query without positives gives none; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, releasing

_PACKED = "n int, width int, ids binary, labels binary, vectors binary"
_FIELDS = pa.schema([("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
#: Share of pairs below which the remaining planes are summed pair by pair, and pairs summed together.
_FEW, _TOGETHER = 1 / 16, 1 << 15
_LOW = -(1 << 62)


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: pa.Array) -> tuple:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), "<i8")
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.append(0, np.cumsum(size)[:-1]), size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    width = 4 if np.abs(out).max(initial=0) < 1 << 31 else 8
    return len(size), width, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), out.astype(f"<i{width}").tobytes()


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, vectors) of a block."""
    ids, labels, vectors = (np.frombuffer(row[side + c], t) for c, t in (("ids", "<i8"), ("labels", "<i8"), ("vectors", f"<i{row[side + 'width']}")))
    return ids, labels, vectors.reshape(row[side + "n"], -1).astype(np.int64)


def prepared(vectors: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """(id, label, vector, query) of the rows that take part."""
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kind = dict(vectors.dtypes)[label_col]
    label = F.col(label_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label_col)
    return vectors.where(sound & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        label.alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    )


def _row_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed where they are read, ``size`` to a block."""

    def run(batches):
        held: list = []

        def packed():
            t = pa.Table.from_batches(held)
            held.clear()
            for i in range(0, t.num_rows, size):
                p = t.slice(i, size)
                block = _packed(p.column("id").to_numpy(), p.column("label").to_numpy(), p.column("vector"))
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, block, strict=True))], _FIELDS)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from packed()
        if sum(b.num_rows for b in held):
            yield from packed()

    return rows.select("id", "label", "vector").mapInArrow(releasing(run), _PACKED)


def _query_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """(slot, packed queries): distinct query rows, dealt to blocks by a hash."""

    def run(table: pa.Table) -> pa.Table:
        block = _packed(table.column("id").to_numpy(), table.column("label").to_numpy(), table.column("vector"))
        named = {"slot": table.column("slot")[0].as_py()} | dict(zip(_FIELDS.names, block, strict=True))
        return pa.Table.from_pylist([named], pa.schema([("slot", pa.int32()), *_FIELDS]))

    queries = rows.select("id", "label", "vector").distinct().withColumn("slot", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(blocks)).cast("int"))
    return queries.groupBy("slot").applyInArrow(run, "slot int, " + _PACKED)


def sliced(queries: np.ndarray, rows: np.ndarray, possible: np.ndarray, dense, few):
    """(query, row, score) of the pairs that no interval rules out.

    ``possible`` marks the pairs to look at.  ``dense(low, high, alive)`` returns which pairs of
    the whole matrix stay, ``few(query, low, high)`` which of a list of pairs.
    """
    bits = max(1, int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length() + 1)
    most = int(np.abs(queries).sum(1).max(initial=0))
    if most << bits >= 1 << 56:
        raise ValueError("scores could exceed 56 bits")
    kind = np.float64 if most << bits < 1 << 52 else np.int64
    q = queries.astype(kind)
    up, down = np.maximum(queries, 0).sum(1), np.minimum(queries, 0).sum(1)
    total = np.zeros(possible.shape, kind)
    weights = [-(1 << bits - 1), *[1 << k for k in range(bits - 2, -1, -1)]]
    alive, pairs = possible, None
    for k, weight in zip(range(bits - 1, -1, -1), weights, strict=True):
        plane, rest = ((rows >> k) & 1).astype(kind), (1 << k) - 1
        if pairs is None:
            total += q @ (plane.T * kind(weight))
            alive = dense(total, rest * down, rest * up, alive)
            if alive.sum() <= alive.size * _FEW:
                i, j = np.nonzero(alive)
                pairs = i, j, total[i, j].astype(np.int64)
        else:
            i, j, s = pairs
            for a in range(0, len(i), _TOGETHER):
                b = slice(a, a + _TOGETHER)
                s[b] += weight * np.einsum("ij,ij->i", q[i[b]], plane[j[b]]).astype(np.int64)
            stay = few(i, s + rest * down[i], s + rest * up[i])
            pairs = i[stay], j[stay], s[stay]
    if pairs is None:
        i, j = np.nonzero(alive)
        pairs = i, j, total[i, j].astype(np.int64)
    return pairs


def _nth_largest(group: np.ndarray, value: np.ndarray, n: int, groups: int) -> np.ndarray:
    """The ``n``-th largest value of each group, a very low number where there are fewer."""
    order = np.lexsort((-value, group))
    g = group[order]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    out = np.full(groups, _LOW)
    at = place == n - 1
    out[g[at]] = value[order][at]
    return out


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Where each group's first ``n`` by score, descending, and id stand, in that order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < n]


def nearest(q_ids, q_labels, q, ids, labels, rows, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the best ``n`` other rows of each query's label."""
    out = []
    for label in np.intersect1d(q_labels, labels):
        a, b = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
        possible = q_ids[a][:, None] != ids[b][None, :]

        def dense(total, low, high, alive):
            known = np.where(alive, total, _LOW)
            if known.shape[1] <= n:
                return alive
            nth = np.partition(known, known.shape[1] - n, axis=1)[:, known.shape[1] - n]
            return alive & (total >= (nth + low - high)[:, None])

        def few(i, low, high):
            return high >= _nth_largest(i, low, n, len(a))[i]

        i, j, s = sliced(q[a], rows[b], possible, dense, few)
        pick = _best(i, s, ids[b][j], n)
        out.append((a[i[pick]], b[j[pick]], s[pick]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def between(q_labels, q, labels, rows, ids, low: np.ndarray, high: np.ndarray, n: int) -> list[tuple]:
    """For each column of ``low`` and ``high`` (queries x ranges): (query, row, score) of the best ``n`` rows of other labels whose score is in the range."""
    some = low <= high
    least = np.where(some, low, 1 << 62).min(1, initial=1 << 62)
    most = np.where(some, high, _LOW).max(1, initial=_LOW)

    def dense(total, lo, hi, alive):
        return alive & (total >= (least - hi)[:, None]) & (total <= (most - lo)[:, None])

    def few(i, lo, hi):
        stay = np.zeros(len(i), bool)
        for k in range(low.shape[1]):
            a, b = low[i, k], high[i, k]
            sure = (lo >= a) & (hi <= b)
            nth = _nth_largest(i[sure], lo[sure], n, len(q))
            stay |= (hi >= a) & (lo <= b) & (a <= b) & (hi >= nth[i])
        return stay

    i, j, s = sliced(q, rows, q_labels[:, None] != labels[None, :], dense, few)
    out = []
    for k in range(low.shape[1]):
        at = np.flatnonzero((s >= low[i, k]) & (s <= high[i, k]))
        at = at[_best(i[at], s[at], ids[j[at]], n)]
        out.append((i[at], j[at], s[at]))
    return out


def _met(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Each block of rows with each block of queries, by an equal join on the query block's number."""
    dealt = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(queries.withColumnsRenamed({c: "q_" + c for c in _FIELDS.names}), "slot")


def _sides(batches):
    """(slot, queries, rows, the joined row) of each meeting of two blocks, with vectors of one length."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            q, x = _unpacked(row, "q_"), _unpacked(row, "")
            dim = max(q[2].shape[1], x[2].shape[1])
            yield row["slot"], *((a, b, np.pad(v, ((0, 0), (0, dim - v.shape[1])))) for a, b, v in (q, x)), row


def _ranked(df: DataFrame, keys: list[str], id_col: str, score: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(id_col))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame,
    is_query: Column,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    query_block: int = 512,
    row_block: int = 4096,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A query's positives are its best ``positives`` other rows of the same label; for
    each, the best ``negatives`` rows of other labels whose score is at least
    ``low_percent`` and at most ``high_percent`` percent of the positive's.
    """
    rows = prepared(vectors, scale, id_col, label_col, vector_col, is_query)
    blocks = 1 + rows.where("query").count() // query_block
    queries = durable(_query_blocks(rows.where("query"), blocks))
    packed = durable(_row_blocks(rows, row_block))

    def find_positives(batches):
        for slot, (q_ids, q_labels, q), (ids, labels, x), _ in _sides(batches):
            i, j, s = nearest(q_ids, q_labels, q, ids, labels, x, positives)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), slot, "<i4")), pa.array(i.astype("<i4")), pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s)], ["slot", "place", "anchor_id", "positive_id", "positive_score"])

    near = _met(packed, queries, blocks).mapInArrow(releasing(find_positives), "slot int, place int, anchor_id long, positive_id long, positive_score long")
    chosen = durable(_ranked(near, ["slot", "place"], "positive_id", "positive_score", positives).withColumnRenamed("rank", "no"))
    # a block of queries with its positives: at most query_block, about, times positives of them
    asked = chosen.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("place", "no", "anchor_id", "positive_id", "positive_score"))).alias("positives"))

    def find_negatives(batches):
        for slot, (_, q_labels, q), (ids, labels, x), row in _sides(batches):
            found = row["positives"]
            place, no, score = (np.array([p[c] for p in found], np.int64) for c in ("place", "no", "positive_score"))
            low, high = np.full((len(q), positives), 1, np.int64), np.zeros((len(q), positives), np.int64)
            low[place, no - 1], high[place, no - 1] = -(-low_percent * score // 100), high_percent * score // 100
            of = np.zeros((len(q), positives), np.int64)
            of[place, no - 1] = np.arange(len(found))
            for k, (i, j, s) in enumerate(between(q_labels, q, labels, x, ids, low, high, negatives)):
                at = [found[p] for p in of[i, k].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), slot, "<i4")), pa.array(i.astype("<i4")), pa.array(np.full(len(i), k, "<i4"))]
                    + [pa.array([p[c] for p in at], pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")]
                    + [pa.array(ids[j]), pa.array(s)],
                    ["slot", "place", "no", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    hard = _met(packed, queries.join(asked, "slot"), blocks).mapInArrow(releasing(find_negatives), "slot int, place int, no int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _ranked(hard, ["slot", "place", "no"], "negative_id", "negative_score", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

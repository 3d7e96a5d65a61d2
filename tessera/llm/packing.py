"""Packing by cutting-stock column generation.

Documents are cut into pieces of at most ``capacity`` tokens (all pieces of a
document but its last are full sequences), and the last pieces are packed so
that no further document is cut.  Lengths are counted in a histogram of classes:
exact up to 128 tokens, then wider by ``fineness``-ths of the length, so a piece
takes up at most one ``fineness``-th more than it has.  This histogram is all that the driver sees.  On
it a linear program over patterns (multisets of classes that fit one sequence) is
solved by column generation: an unbounded-knapsack dynamic program over the dual
prices finds the next patterns, until its prices prove (by Farley's bound) that no
solution has over a ``gap``-th fewer sequences, or ``patience`` runs together saved
less than half of that.  A best-fit packing in small gives the first
patterns.  The patterns' multiplicities
are rounded down, the few pieces left (fewer than classes times pieces of a
pattern) are placed by best-fit decreasing, and pieces, ranked within their class,
take the slots.

Defined cases: null text counts as empty; an empty document is one piece that
holds the end token; an empty table gives no rows; repeated rows of one doc_id
are packed separately; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable, partitions, releasing

_CACHE_WORDS = 1_000_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts, by encoding each distinct word once.

    The tokenizer must lower-case, drop white space before it looks for pieces,
    and take runs of letters apart from what follows, as ``word_bpe_49k.json``
    does: then the ids of a text are those of its parts in turn, where a part
    ends at a blank, or after an ASCII letter that another ASCII character
    follows (only at blanks where a text may hold added tokens, which all begin
    with ``<|``).  Parts of a slice are brought together by 64-bit hashes, then
    compared byte by byte; the parts known so far are found by their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.fold = all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values())
        self._empty()

    def _empty(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[bytes]) -> None:
        """Encode new parts; those of ASCII letters alone, each with one closing piece, at its end, in one call."""
        parts = [k.decode() for k in keys]
        found: list[np.ndarray | None] = [None] * len(parts)
        plain = [k for k, w in enumerate(parts) if w.isascii() and w.isalpha()]
        ids = np.array(self.tokenizer.encode(" ".join(parts[k] for k in plain), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.closes[ids]) + 1
        if len(cuts) == len(plain):
            for k, a, b in zip(plain, np.append(0, cuts)[:-1].tolist(), cuts.tolist(), strict=True):
                found[k] = ids[a:b]
        rest = [k for k, x in enumerate(found) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = np.array(e.ids, "<u4")
        sizes = np.array([len(x) for x in found])
        n, total = len(self.row), int(sizes.sum())
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < n + len(parts):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.concatenate(found)
        self.size[n : n + len(parts)] = sizes
        self.start[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.row.update(zip(keys, range(n, n + len(parts)), strict=True))

    def encode(self, column: pa.Array):
        """(ids of all rows, number of ids before each row's end with 0 first) for each slice of rows."""
        for i, j in K.slices(column):
            data, offsets, _ = K.parts(column[i:j])
            at, buf = offsets - offsets[0], data[offsets[0] : offsets[-1]]
            # "<|" may open an added token, which is matched before anything else.
            fold = self.fold and b"<|" not in buf.tobytes()
            start, end = self._bounds(buf, at, fold)
            if len(self.row) > _CACHE_WORDS:
                self._empty()
            keys, which = self._distinct(K.LOWER[buf] if fold else buf, start, end)
            new = [k for k in keys if k not in self.row]
            if new:
                self._add(list(dict.fromkeys(new)))
            row = np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))[which] if keys else np.zeros(0, np.int64)
            size = self.size[row]
            total = np.append(0, np.cumsum(size))
            ids = self.flat[np.repeat(self.start[row] - total[:-1], size) + np.arange(total[-1])]
            yield ids, total[np.searchsorted(start, at)]

    @staticmethod
    def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The different parts, and which of them each part is."""
        if not len(start):
            return [], start
        raw = buf.tobytes()
        _, first, which = np.unique(K.hash_bytes(buf, start, end), return_index=True, return_inverse=True)
        like, size = first[which], end - start
        same = (size[like] == size).all()
        if same:
            # All bytes of all parts, beside those of the first part with their hash.
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            same = (buf[np.repeat(start, size) + at] == buf[np.repeat(start[like], size) + at]).all()
        if not same:
            first, which = np.arange(len(start)), np.arange(len(start))
        return [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], which

    @staticmethod
    def _bounds(buf: np.ndarray, at: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
        ink = ~K._BLANK[buf]
        first = ink.copy()
        letter = _LETTER[buf]
        first[1:] &= ~ink[:-1] | (letter[:-1] & ~letter[1:] & (buf[1:] < 128)) if within else ~ink[:-1]
        edge = at[(at > 0) & (at < len(buf))]
        first[edge] = ink[edge]
        start = np.flatnonzero(first)
        last = np.zeros(len(buf) + 1, bool)
        last[1:] = ink
        last[1:-1] &= ~ink[1:] | first[1:]
        last[edge] = ink[edge - 1]
        return start, np.flatnonzero(last)


def encoder(path: str) -> WordEncoder:
    """One for each worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, doc_tokens, ids_crc32[, ids]).

    ``ids`` is binary: little-endian unsigned 32-bit token ids.
    """

    def run(batches):
        for batch in batches:
            i = 0
            for ids, ends in encoder(tokenizer_path).encode(batch.column(1)):
                n = len(ends) - 1
                size = np.diff(ends) + 1
                flat = np.full(int(size.sum()), end_id, "<u4")
                keep = np.ones(len(flat), bool)
                keep[np.cumsum(size) - 1] = False
                flat[keep] = ids
                many = -(-size // capacity)
                doc = np.repeat(np.arange(n), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                length = np.minimum(capacity, size[doc] - piece * capacity)
                begin = (np.cumsum(size) - size)[doc] + piece * capacity
                raw = flat.tobytes()
                parts = [raw[4 * a : 4 * (a + k)] for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
                arrays = [batch.column(0)[i : i + n].take(pa.array(doc)), *map(pa.array, (piece, piece * capacity, length, size[doc])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "doc_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                i += n

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(run), schema)


def classes(capacity: int, quantum: int = 1, fineness: int = 64) -> np.ndarray:
    """The greatest length of each class, ascending up to ``capacity``; all are multiples of ``quantum``."""
    if capacity % quantum:
        raise ValueError("capacity must be a multiple of quantum")
    out = [0]
    while out[-1] < capacity:
        out.append(min(capacity, out[-1] + quantum * max(1, out[-1] // (fineness * quantum))))
    return np.array(out[1:])


def best_patterns(price: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming; weights ascend.

    The value of the best pattern within ``room``, and for each class the best
    pattern that has a piece of it.
    """
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(weight, np.arange(room + 1), "right").tolist()
    for r in range(int(weight[0]), room + 1):
        k = fits[r]
        options = value[r - weight[:k]]
        options += price[:k]
        best = options.argmax()
        if options[best] > value[r - 1] + 1e-12:
            value[r], pick[r] = options[best], best
        else:
            value[r] = value[r - 1]
    # Of each room, the least one that is worth as much.
    at = np.maximum.accumulate(np.where(pick >= 0, np.arange(room + 1), 0)).tolist()
    pick, sizes = pick.tolist(), weight.tolist()
    out = np.eye(len(weight), dtype=np.int64)
    for c, row in enumerate(out):
        r = at[room - sizes[c]]
        while r:
            row[pick[r]] += 1
            r = at[r - sizes[pick[r]]]
    return float(value[room]), out


def best_fit(demand: np.ndarray, weight: np.ndarray, room: int) -> list[np.ndarray]:
    """One pattern per sequence, by best-fit decreasing."""
    left, bins = demand.copy(), []
    # Free room of each bin, ascending, with the bin.
    free: list[tuple[int, int]] = []
    for c in np.flatnonzero(left)[::-1]:
        w = int(weight[c])
        while left[c]:
            at = bisect.bisect_left(free, (w, -1))
            if at == len(free):
                bins.append(np.zeros(len(left), np.int64))
                free.append((room, len(bins) - 1))
            r, k = free.pop(at)
            n = min(int(left[c]), r // w)
            bins[k][c] += n
            left[c] -= n
            bisect.insort(free, (r - n * w, k))
    return bins


def cutting_stock(demand: np.ndarray, weight: np.ndarray, room: int, gap: float = 0.005, patience: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row) and how often the linear program uses each.

    ``demand[i]`` pieces of weight ``weight[i]`` (ascending, none without demand)
    are to be cut from stock of weight ``room``.  Revised simplex over the patterns
    found so far, then the knapsack prices in new ones, until at most a ``gap``-th
    could be saved: any prices, divided by the worth of their best pattern, are a
    dual solution and so a bound.  Bounds improve slowly at the end, so it also ends
    when ``patience`` runs of the knapsack saved less than half of ``gap``.  The
    knapsack's prices are smoothed: they lie between the current ones and those of
    the best bound, which start as the weights.
    """
    m = len(weight)
    basis = np.diag(room // weight) if m else np.zeros((0, 0), np.int64)
    if not m:
        return basis, np.zeros(0)
    known, pivots, share = basis.astype(float), 0, 0.9
    inverse = np.linalg.inv(basis.T)
    x = inverse @ demand
    # Also known from the start are the patterns of a packing in small.
    known = np.concatenate([known, best_fit(-(-demand * 4000 // demand.sum()), weight, room)])
    safe = weight / room
    bound, totals = demand @ safe, [math.inf] * patience
    while x.sum() > bound * (1 + gap) and x.sum() < totals[-patience] * (1 - gap / 2):
        price = inverse.sum(axis=0)
        mixed = share * safe + (1 - share) * price
        value, found = best_patterns(mixed, weight, room)
        if demand @ mixed > bound * value:
            bound, safe = demand @ mixed / value, mixed / value
        found = found[found @ price > 1 + gap / 4]
        if not len(found) and math.isfinite(totals[-1]):
            if share == 0:
                break
            share = share / 2 if share > 0.1 else 0
            continue
        share = 0.9
        totals.append(x.sum())
        known = np.concatenate([known[known @ price > 0.9 if math.isfinite(totals[-2]) else slice(None)], np.unique(found, axis=0).astype(float)])
        # So many pivots at most, since degenerate ones may go round; any basis is feasible.
        for _ in range(20 * m):
            worth = known @ inverse.sum(axis=0)
            best = int(worth.argmax())
            if worth[best] <= 1 + gap / 4:
                break
            d = inverse @ known[best]
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            k = int(np.argmin(ratio))
            x = np.maximum(x - ratio[k] * d, 0)
            x[k] = ratio[k]
            basis[k] = known[best]
            pivots += 1
            if pivots % 50 == 0:
                # Afresh, against errors that add up.
                inverse = np.linalg.inv(basis.T)
                x = np.maximum(inverse @ demand, 0)
            else:
                inverse[k] /= d[k]
                inverse -= np.outer(np.where(np.arange(m) == k, 0, d), inverse[k])
    return basis, x


def slots(demand: np.ndarray, weight: np.ndarray | None = None) -> pd.DataFrame:
    """Where the pieces of each class go: (cls, first, last, per, sequence).

    ``weight`` (1, 2, 3 ... if not given) ends with the room of a sequence.

    Pieces of class ``cls`` with rank in [first, last) go to sequences
    ``sequence + (rank - first) // per``.
    """
    weight = np.arange(1, len(demand) + 1) if weight is None else weight
    there, room = np.flatnonzero(demand), int(weight[-1])
    weight, left = weight[there], demand[there].copy()
    patterns, times = cutting_stock(left, weight, room)
    rows, taken, sequence = [], np.zeros(len(left), np.int64), 0

    def use(pattern: np.ndarray, n: int) -> None:
        nonlocal sequence
        for c in np.flatnonzero(pattern):
            per = int(pattern[c])
            rows.append((int(there[c]), int(taken[c]), int(taken[c] + n * per), per, sequence))
            taken[c] += n * per
        sequence += n

    for p, t in zip(patterns, times, strict=True):
        n = int(t + 1e-9)
        n = min([n, *(int(left[c] // p[c]) for c in np.flatnonzero(p))])
        if n > 0:
            use(p, n)
            left -= n * p
    bins = best_fit(left, weight, room)
    for b in bins:
        use(b, 1)
    return pd.DataFrame(rows, columns=["cls", "first", "last", "per", "sequence"])


def assign(parts: DataFrame, capacity: int = 4096, quantum: int = 1) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length``.

    Ranks come from counts by (class, salt) and a window within one of them, so
    a class of any size is ranked in many tasks.  The order within a class is
    that of salts of doc_id, then doc_id.
    """
    spark, upper = parts.sparkSession, classes(capacity, quantum)
    salts = 4 * partitions(spark)
    # Class and full pieces by a lookup in a constant array, indexed by length.
    cls = np.searchsorted(upper, np.arange(1, capacity + 1)).tolist()
    parts = parts.withColumn("cls", F.get(F.lit(cls), F.col("length").cast("int") - 1)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    counts = durable(parts.groupBy("cls", "salt").count())
    demand = np.zeros(len(upper), np.int64)
    for c, n in counts.groupBy("cls").agg(F.sum("count")).collect():  # one row for each class at most
        demand[c] = n
    whole = int(demand[-1])
    demand[-1] = 0
    table = slots(demand, upper)
    base = int((table["sequence"] + (table["last"] - table["first"]) // table["per"]).max()) if len(table) else 0
    # The last class is full or nearly full pieces, each a sequence of its own.
    table.loc[len(table)] = (len(upper) - 1, 0, whole, 1, base)
    lookup = {int(c): g.sort_values("first")[["first", "per", "sequence"]].to_numpy() for c, g in table.groupby("cls")}
    # At most classes times salts rows; a task sums one class, 4 numbers a shuffle partition.
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("cls", "salt", F.coalesce("before", F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def sequence(cls: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(cls), np.int64)
        c, r = cls.to_numpy(), rank.to_numpy()
        for k in np.unique(c):
            first, per, seq = lookup[int(k)].T
            at = np.flatnonzero(c == k)
            j = np.searchsorted(first, r[at], "right") - 1
            out[at] = seq[j] + (r[at] - first[j]) // per[j]
        return pd.Series(out)

    local = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in parts.columns])) - 1
    ranked = parts.withColumn("rank", local).join(before, ["cls", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.withColumn("sequence_id", sequence("cls", "rank"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("cls", "salt", "rank", "before")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, quantum: int = 1, with_ids: bool = True) -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece, with its token ids unless ``with_ids`` is off."""
    return assign(durable(pieces(docs, tokenizer_path, end_id, capacity, with_ids=with_ids)), capacity, quantum)

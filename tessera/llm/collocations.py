"""Collocations by contiguous pattern growth over projected occurrences.

A phrase is frequent only if all its contiguous parts are, so longer phrases are
grown from the occurrences of shorter ones, always to the right:

1.  Words are counted for each language, and those below ``min_count`` set aside.
2.  Neighbouring pairs of frequent words are counted.
3.  Each occurrence of a frequent pair is projected to a pointer record: its words
    and those that follow it, up to ``max_words``, cut where the next pair can't be
    frequent.  Equal records are merged in the task that makes them.
4.  Records are dealt to tasks by their prefix and sorted, so that every prefix's
    projection is a range of rows.  Each task extends its prefixes to the right,
    depth first: the next column cuts a prefix's range into its extensions' ranges.
    The third word counts as part of the prefix that decides the task, so that a
    hot pair's projection is spread; its partial counts are summed afterwards.  A
    task holds ``_CHUNK`` records at a time; a range that crosses a chunk's edge
    also gives partial counts, so no group has to fit in memory.
5.  Scores are joins of the frequent phrases with themselves, in exact decimals.

What tells frequent words and pairs in steps 2 and 3 is a bit table of at most
``2 ** _BITS`` bits.  It can let rare ones through, which then fail the count, and
never loses one; so its size bounds what is broadcast and affects cost only.

Words are told apart by 64-bit hashes of language and word.

Defined cases: null texts are empty and a null language is ``und``; a text of any
length is read whole; repeated rows and repeated ids count each time; an empty table,
or one without a frequent phrase, gives no rows; columns other than the named ones
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable, partitions, releasing

_U = np.uint64
_BITS = 27
#: Pointer records of one call of ``_grow``.
_CHUNK = 1 << 18
#: Bytes of text that are counted together in a task.
_SLICE = 4 << 20
_NEXT = _U(0x9E3779B97F4A7C15)
_PAIR = np.dtype([("key", "<u8"), ("n", "<u4")])
#: What ends a piece, and what separates its words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_APART = _BREAK.copy()
_APART[[ord(c) for c in BLANKS]] = True


def _lang_hashes(langs: list[str]) -> np.ndarray:
    data, offsets, _ = K.parts(pa.array([x + "\n" for x in langs], pa.large_string()))
    return K.hash_bytes(data, offsets[:-1], offsets[1:])


class _Slice:
    """The words of some rows: their ids, the pieces they are in, and where they are."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, offsets, _ = K.parts(text)
        at = offsets - offsets[0]
        self.buf = K.LOWER[data[offsets[0] : offsets[-1]]]
        ink = ~_APART[self.buf]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        inner = at[1:-1]
        inner = inner[(inner > 0) & (inner < len(ink))]
        first[inner] = ink[inner]
        last[inner - 1] = ink[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        codes = lang.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        row = np.searchsorted(at, self.start, "right") - 1
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[row]
        self.id = np.zeros(0, _U)
        self.piece = np.cumsum(_BREAK[self.buf])[self.start] + row if len(self.start) else self.start
        if len(self.start):
            self.id = K.mix(K.hash_bytes(self.buf, self.start, self.end) + _lang_hashes(self.langs)[self.lang])
            self.id[self.id == 0] = 1  # 0 stands for no word

    def pairs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word and the next one may both be frequent and share a piece, key of the pair)."""
        ok = _has(words, self.id)
        ok = ok[:-1] & ok[1:] & (self.piece[:-1] == self.piece[1:])
        return ok, K.mix(self.id[:-1] * _NEXT + self.id[1:])


def _slices(batches):
    for batch in batches:
        text, lang = batch.column(0), batch.column(1)
        for i, j in K.slices(text, _SLICE):
            x = _Slice(text[i:j], lang[i:j])
            if len(x.id):
                yield x


def _has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & _U(len(table) * 8 - 1)
    return (table[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & np.uint8(1) > 0


def _bit_table(keys: DataFrame, most: int) -> np.ndarray:
    """Bits of the long column ``key``; the driver gets one row for 64 bits, bounded by the table's size."""
    bits = min(_BITS, max(10, int(most * 16).bit_length()))
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    words = keys.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("w")).toArrow()
    out = np.zeros((1 << bits) // 64, "<i8")
    out[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return out.view(np.uint8)


def _count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, id, n) of every slice's words, with a null word for all of a language together."""

    def run(batches):
        for x in _slices(batches):
            ids, first, n = np.unique(x.id, return_index=True, return_counts=True)
            raw = x.buf.tobytes()
            words = [raw[a:b].decode() for a, b in zip(x.start[first].tolist(), x.end[first].tolist(), strict=True)]
            all_of = np.bincount(x.lang, minlength=len(x.langs))
            langs = pa.array(x.langs, pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([langs.take(pa.array(x.lang[first])), langs]),
                    pa.array(words + [None] * len(langs), pa.string()),
                    pa.array(np.append(ids.view("<i8"), np.zeros(len(langs), "<i8"))),
                    pa.array(np.append(n, all_of).astype("<i8")),
                ],
                ["lang", "word", "id", "n"],
            )

    return docs.mapInArrow(releasing(run), "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def _frequent_pairs(docs: DataFrame, words: np.ndarray, min_count: int, shards: int) -> DataFrame:
    """(key) of the pairs that occur often enough, counted by shard from packed records."""

    def count(batches):
        for x in _slices(batches):
            ok, key = x.pairs(words)
            keys, n = np.unique(key[ok], return_counts=True)
            rec = np.empty(len(keys), _PAIR)
            rec["key"], rec["n"] = keys, n
            target = (keys >> _U(32)) % _U(shards)
            order = np.argsort(target, kind="stable")
            cut = np.searchsorted(target[order], np.arange(shards + 1, dtype=_U))
            rec, at = rec[order], np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("<i4")), pa.array([rec[cut[k] : cut[k + 1]].tobytes() for k in at.tolist()], pa.binary())], ["target", "data"])

    def total(table: pa.Table) -> pa.Table:
        rec = np.frombuffer(b"".join(table.column("data").to_pylist()), _PAIR)
        rec = rec[np.argsort(rec["key"], kind="stable")]
        first = np.flatnonzero(np.append(True, rec["key"][1:] != rec["key"][:-1]))
        often = np.add.reduceat(rec["n"], first, dtype=np.int64) >= min_count
        return pa.table({"key": pa.array(rec["key"][first[often]].view("<i8"))})

    return docs.mapInArrow(releasing(count), "target int, data binary").groupBy("target").applyInArrow(total, "key long")


def _project(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, most: int) -> DataFrame:
    """Pointer records (w1, ..., n): the words from each occurrence of a frequent pair on; 0 where a record ends."""

    def run(batches):
        for x in _slices(batches):
            ok, key = x.pairs(words)
            ok[ok] = _has(pairs, key[ok])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            more = np.append(ok, np.zeros(most, bool))
            ids = np.append(x.id, np.zeros(most, _U))
            w, on, mark = [ids[at], ids[at + 1]], np.ones(len(at), bool), K.mix(ids[at] * _NEXT + ids[at + 1])
            for k in range(2, most):
                on = on & more[at + k - 1]
                w.append(np.where(on, ids[at + k], _U(0)))
                mark = np.where(on, K.mix(mark * _NEXT + w[-1]), mark)
            mark, first, n = np.unique(mark, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[first].view("<i8")) for c in w], pa.array(n.astype("<i8"))], [f"w{k + 1}" for k in range(most)] + ["n"])

    return docs.mapInArrow(releasing(run), ", ".join(f"w{k + 1} long" for k in range(most)) + ", n long")


def _grow(w: list[np.ndarray], n: np.ndarray, min_count: int):
    """(words, count) of the patterns of sorted pointer records, depth first.

    Pairs are given with whatever count they have here; of longer patterns those that
    are frequent, or that touch the first or last record and may go on beyond it.
    """
    total, size = np.append(0, np.cumsum(n)), len(n)

    def extend(prefix: tuple, lo: int, hi: int):
        column = w[len(prefix)][lo:hi]
        cut = lo + np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        ends = np.append(cut[1:], hi)
        counts = total[ends] - total[cut]
        wanted = (counts >= min_count) | (cut == 0) | (ends == size) | (len(prefix) < 2)
        for a, b, c in zip(cut[wanted].tolist(), ends[wanted].tolist(), counts[wanted].tolist(), strict=True):
            if w[len(prefix)][a] == 0:
                continue
            found = (*prefix, int(w[len(prefix)][a]))
            if len(found) > 1:
                yield found, c
            if len(found) < len(w) and (c >= min_count or a == 0 or b == size or not prefix):
                yield from extend(found, a, b)

    yield from extend((), 0, size)


def _phrases(projected: DataFrame, min_count: int, most: int) -> DataFrame:
    """(ids, n) of all frequent phrases of two words or more."""
    names = [f"w{k + 1}" for k in range(most)]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def grown():
            table = pa.Table.from_batches(held)
            held.clear()
            w = [table.column(c).to_numpy() for c in names]
            found = list(_grow(w, table.column("n").to_numpy(), min_count))
            return pa.RecordBatch.from_arrays([pa.array([list(x) for x, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.int64())], ["ids", "n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _CHUNK:
                yield grown()
        if sum(b.num_rows for b in held):
            yield grown()

    # a prefix is the first three words, or two where a record has no more
    tasks = projected.repartition(partitions(projected.sparkSession), *names[:3]).sortWithinPartitions(*names)
    return tasks.mapInArrow(releasing(run), "ids array<long>, n long").groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, absorb_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one absorbs."""
    longer = phrases.where(F.size("ids") > 1)
    sub = "flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))"
    inside = longer.where(F.size("ids") > 2).select(F.explode(F.expr(sub)).alias("ids"), F.col("n").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    left = longer.join(inside, "ids", "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(38,0)") * exact("longer") < F.lit(absorb_percent) * exact("n")))
    cuts = left.select("ids", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumn("x", F.expr("slice(ids, 1, k)")).withColumn("y", F.expr("slice(ids, k + 1, size(ids))"))
    part = phrases.select(F.col("ids").alias("part"), F.col("n").alias("m"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "x", "m": "l"}), "x").join(part.withColumnsRenamed({"part": "y", "m": "r"}), "y")
    cuts = cuts.withColumn("id", F.col("ids")[0]).join(words.select("id", "lang"), "id").join(totals.withColumnRenamed("n", "all"), "lang")
    cuts = cuts.withColumn("num", F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("all")).withColumn("den", exact("l") * exact("r")).withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.first("a").alias("a"), F.first("all").alias("n"))
    named = best.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return best.join(named, "ids").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, absorb_percent: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of 2 to ``max_words`` words that occurs ``min_count`` times or more.

    ``n`` counts the language's words, ``a`` the phrase's occurrences, ``l`` and ``r``
    those of its two parts at the cut with the lowest score
    floor(1000 * a * n / (l * r)), the smallest such cut.  A phrase inside a longer
    candidate that occurs ``absorb_percent`` percent as often, or more, is dropped.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("max_words must be 2 or more and min_count 1 or more")
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), 1 + size // (32 << 20))
    counted = durable(_count_words(docs).where(F.col("word").isNull() | (F.col("n") >= min_count)))
    words, totals = counted.where("word is not null"), counted.where("word is null").select("lang", "n")
    frequent = _bit_table(words.select(F.col("id").alias("key")), words.count())
    keys = durable(_frequent_pairs(docs, frequent, min_count, shards))
    pairs = _bit_table(keys, keys.count())
    found = _phrases(_project(docs, frequent, pairs, max_words), min_count, max_words)
    phrases = durable(found.unionByName(words.select(F.array("id").alias("ids"), "n")))
    return _scored(phrases, words, totals, absorb_percent)


def top(scored: DataFrame, k: int = 2000) -> DataFrame:
    """The first ``k`` phrases of each language, by score, count and phrase, with their ``rank``; each task keeps ``k`` of a language before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))

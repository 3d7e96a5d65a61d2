"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of every window of ``window`` words, the ``gram``-word
run with the least hash.  Neighbouring windows with the same anchor form one
stretch, and two equal windows always have equal anchors, so only stretches that
share an anchor can hold a match.

1.  A scan lists each document's stretches as (anchor, whole-stretch hash).
2.  They are joined on the anchor.  Equal whole stretches match over their full
    extent.  Stretches that share only the anchor are extended both ways: each
    window around the anchor is hashed and looked up among the same anchor's.
3.  Matched windows are merged into maximal repeats, and their words removed.

Documents are dealt to blocks by a hash of their id; what is looked up travels
as packed numbers between blocks and hash shards, and the text moves only to its
block.  A hash that is frequent within one task is decided there and at most
``_HERE`` records of it are sent on, so a passage, however common, makes a group
of that many records a task.  Stretches count as equal when a 64-bit hash of
their words and the 64-bit hash of their anchor agree, single windows when two
64-bit hashes of their words do.

Defined cases: null and empty texts have no words; documents under ``window``
words lose nothing; repeated rows of one doc_id are separate documents that
match each other; an empty table gives no rows; other columns are ignored, and a
kept column with the name of a result is returned as ``<name>_in``.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable, partitions, releasing

_U = np.uint64
_BITS = 22
_OTHER = _U(0x8EBC6AF09C88C6E3)
_OPEN = np.dtype([("a", "<u8"), ("s", "<u8"), ("block", "<u4")])
#: Block of a record that only counts.
_NOWHERE = 0xFFFFFFFF
#: Records of one anchor that a task sends on undecided.
_HERE = 16
_INK = re.compile(rb"[^\x20\x09-\x0D]+")
_SENT = "side int, target int, data binary"


class Stretches:
    """The stretches of the rows of a string column slice."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        data, offsets, _ = K.parts(column)
        h, self.ends = K.words(data, offsets)
        self.window, n = window, len(h)
        self.words = n
        self.runs = K.Runs(h)
        empty = np.zeros(0, np.int64)
        self.start = self.length = self.doc = empty
        self.anchor = self.whole = np.zeros(0, _U)
        if n < window:
            return
        if n >= 1 << _BITS:
            bits = int(n).bit_length()
        else:
            bits = _BITS
        low = _U((1 << bits) - 1)
        doc = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        at = np.arange(n - gram + 1)
        grams = self.runs.of(at, gram)
        least = K.sliding_min((grams & ~low) | at.astype(_U), window - gram + 1)
        valid = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        if not len(valid):
            return
        anchor = (least[valid] & low).astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        self.start = valid[first]
        self.length = np.diff(np.append(first, len(valid)))
        anchor = anchor[first]
        self.doc = doc[self.start]
        self.anchor = grams[anchor]
        shift = (anchor - self.start).astype(_U) * _U(0xE7037ED1A0B428DB)
        self.whole = K.mix(self.runs.of(self.start, self.length + window - 1) + shift)

    def windows(self, which: np.ndarray) -> np.ndarray:
        """Starts of all windows of these stretches."""
        n = self.length[which]
        return np.repeat(self.start[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return self.runs.of(at, self.window)

    def others(self, at: np.ndarray) -> np.ndarray:
        """Second hashes of windows, from other hashes of the words."""
        return K.Runs(K.mix(self.runs.level[0] ^ _OTHER)).of(at, self.window)


def _send(rows: list, side: int, targets: np.ndarray, data: np.ndarray) -> None:
    """One row per target with its part of ``data``."""
    if not len(data):
        return
    order = np.argsort(targets, kind="stable")
    targets, data = targets[order], data[order]
    cut = np.flatnonzero(np.append(True, targets[1:] != targets[:-1]))
    for i, j in zip(cut, np.append(cut[1:], len(data)), strict=True):
        rows.append((side, int(targets[i]), data[i:j].tobytes()))


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["side", "target", "data"])


def _joined(table: pa.Table, column: str = "data") -> bytes:
    return b"".join(table.column(column).to_pylist())


def _runs(rec: np.ndarray, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """For sorted records: the run, equal in these fields, that each is in, and the runs' lengths."""
    run = np.cumsum(_firsts(rec, *names)) - 1
    return run, np.bincount(run) if len(rec) else np.zeros(0, np.int64)


class SubstringDedup:
    """The passes; sides 0: to a shard, 1: matched whole stretches or windows for a block, 2: stretches for a block to extend."""

    def __init__(self, docs: DataFrame, window: int, gram: int, block_bytes: int, id_col: str, text_col: str, keep: list[str]):
        self.spark, self.window, self.gram = docs.sparkSession, window, gram
        self.kept = [(c, f"__{k}") for k, c in enumerate(keep)]
        docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(k) for c, k in self.kept if c not in (id_col, text_col)])
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = int(max(partitions(self.spark), 1 + total // block_bytes))
        self.shards = self.blocks
        self.docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(self.blocks)).cast("int"))

    def scan(self) -> DataFrame:
        window, gram, shards = self.window, self.gram, self.shards

        def run(batches):
            for batch in batches:
                text, block = batch.column(0), batch.column(1).to_numpy()
                for i, j in K.slices(text):
                    rows: list = []
                    x = Stretches(text[i:j], window, gram)
                    rec = np.zeros(len(x.whole), _OPEN)
                    rec["a"], rec["s"], rec["block"] = x.anchor, x.whole, block[i:j][x.doc]
                    _settle(rows, rec, shards)
                    if rows:
                        yield _batch(rows)

        return durable(self.docs.select("text", "block").mapInArrow(releasing(run), _SENT))

    def match(self, sent: DataFrame) -> DataFrame:
        """Join on the anchor: what each block has to take whole, and what it has to extend."""

        def run(table: pa.Table) -> pa.Table:
            rec = np.frombuffer(_joined(table), _OPEN)
            rec, rows = rec[np.lexsort((rec["block"], rec["s"], rec["a"]))], []
            run_s, n_s = _runs(rec, "a", "s")
            run_a, n_a = _runs(rec, "a")
            first_s, real = _firsts(rec, "a", "s"), rec["block"] != _NOWHERE
            matched = n_s[run_s] > 1
            extend = np.bincount(run_a[first_s], minlength=len(n_a))[run_a] > 1
            new = _firsts(rec, "a", "s", "block")
            for side, mask in ((1, matched & real & new), (2, extend & real & new & (first_s | ~matched))):
                _send(rows, side, rec["block"][mask], rec["s"][mask])
            return pa.Table.from_batches([_batch(rows)])

        return sent.where("side = 0").groupBy("target").applyInArrow(run, _SENT)

    def per_block(self, told: DataFrame) -> DataFrame:
        return told.select(F.col("target").alias("block"), "side", "data")

    def extend(self, told: DataFrame) -> DataFrame:
        """Hashes of all windows of stretches to extend, dealt to shards."""
        window, gram, shards = self.window, self.gram, self.shards

        def run(docs: pa.Table, told: pa.Table) -> pa.Table:
            rows: list = []
            if told.num_rows and docs.num_rows:
                block = docs.column("block")[0].as_py()
                wanted = np.unique(np.frombuffer(_joined(told), "<u8"))
                text = docs.column("text").combine_chunks()
                for i, j in K.slices(text):
                    x = Stretches(text[i:j], window, gram)
                    at = x.windows(np.flatnonzero(np.isin(x.whole, wanted)))
                    if not len(at):
                        continue
                    rec = np.zeros(len(at), _OPEN)
                    rec["a"], rec["s"], rec["block"] = x.others(at), x.hashes(at), block
                    _settle(rows, rec, shards, windows=True)
            return pa.Table.from_batches([_batch(rows)])

        left = self.docs.select("block", "doc_id", "text").groupBy("block")
        return durable(left.cogroup(self.per_block(told.where("side = 2")).groupBy("block")).applyInArrow(run, _SENT))

    def remove(self, told: DataFrame) -> DataFrame:
        window, gram = self.window, self.gram

        def run(docs: pa.Table, told: pa.Table) -> pa.Table:
            hashes = [np.unique(np.frombuffer(b"".join(d for d, s in zip(told.column("data").to_pylist(), told.column("side").to_pylist(), strict=True) if s == k), "<u8")) for k in (1, 3)]
            ids, n_words, n_removed, kept, cut, spans = [], [], [], [], [], []
            text = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
            for i, j in K.slices(text):
                x = Stretches(text[i:j], window, gram)
                gone = np.zeros(x.words + 1, np.int32)
                if len(x.whole):
                    at = x.windows(np.flatnonzero(np.isin(x.whole, hashes[0])))
                    if len(hashes[1]):
                        rest = x.windows(np.arange(len(x.whole)))
                        at = np.union1d(at, rest[np.isin(x.hashes(rest), hashes[1])])
                    gone[at] += 1
                    gone[at + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                for k, (s, raw) in enumerate(zip(text[i:j], range(i, j), strict=True)):
                    a, b = x.ends[k], x.ends[k + 1]
                    g = gone[a:b]
                    raw = s.as_py().encode()
                    parts = raw.split()
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                    n_words.append(int(b - a))
                    n_removed.append(int(g.sum()))
                    kept.append(b" ".join(compress(parts, (~g).tolist()) if len(edge) else parts).decode())
                    cut.append(_cut(raw, g).decode() if len(edge) else None)
                    spans.append([{"start": int(p), "length": int(q - p)} for p, q in edge.reshape(-1, 2)])
                ids += docs.column("doc_id")[i:j].to_pylist()
            out = pa.table({"doc_id": pa.array(ids, docs.schema.field("doc_id").type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "cut_text": pa.array(cut, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))})
            for c in extra:
                out = out.append_column(c, docs.column(c))
            return out

        kinds = dict(self.docs.dtypes)
        extra = [c for c in self.docs.columns if c.startswith("__")] + ["text"] * bool(self.kept)
        schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_text string, cut_text string, removed array<struct<start: long, length: long>>" + "".join(f", {c} {kinds[c]}" for c in extra)
        return self.docs.groupBy("block").cogroup(self.per_block(told).groupBy("block")).applyInArrow(run, schema)

    def frequent(self, sent: DataFrame) -> DataFrame:
        """Windows that start at two places or more, for the blocks that hold them."""

        def run(table: pa.Table) -> pa.Table:
            rec = np.frombuffer(_joined(table), _OPEN)
            rows: list = []
            rec = rec[np.lexsort((rec["s"], rec["a"]))]
            which, n = _runs(rec, "a", "s")
            mask = (n[which] > 1) & (rec["block"] != _NOWHERE)
            _send(rows, 3, rec["block"][mask], rec["s"][mask])
            return pa.Table.from_batches([_batch(rows)])

        return sent.where("side = 0").groupBy("target").applyInArrow(run, _SENT)


def _cut(raw: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked in ``gone`` and the blanks after each."""
    starts = [m.start() for m in _INK.finditer(raw)]
    kept = [raw[: starts[0]]]
    kept += [raw[a:b] for a, b, g in zip(starts, [*starts[1:], len(raw)], gone.tolist(), strict=True) if not g]
    return b"".join(kept)


def _firsts(rec: np.ndarray, *names: str) -> np.ndarray:
    """Whether each entry of sorted records differs from the one before it in these fields."""
    new = np.zeros(len(rec), bool)
    new[:1] = True
    for n in names:
        new[1:] |= rec[n][1:] != rec[n][:-1]
    return new


def _settle(rows: list, rec: np.ndarray, shards: int, windows: bool = False) -> None:
    """Send records to their anchors' shards; what is frequent here is decided here.

    Of an anchor found more than ``_HERE`` times, the blocks are told at once which
    stretches match and which to extend, and the shard gets two of its stretches,
    each with a second record without a block if it matched.  That is all that
    other tasks need: whether the anchor has several stretches, and one place
    where each matched stretch gets extended.
    """
    if not len(rec):
        return
    rec = rec[np.lexsort((rec["block"], rec["s"], rec["a"]))]
    run_a, n_a = _runs(rec, "a")
    common = n_a[run_a] > _HERE
    out = [rec[~common]]
    rec = rec[common]
    if len(rec):
        run_s, n_s = _runs(rec, "a", "s")
        twice, first_s = n_s[run_s] > 1, _firsts(rec, "a", "s")
        told = rec[twice & _firsts(rec, "a", "s", "block")]
        _send(rows, 3 if windows else 1, told["block"], told["s"])
        run_a, n_a = _runs(rec, "a")
        order = np.cumsum(first_s) - 1
        order -= order[np.flatnonzero(_firsts(rec, "a"))][run_a]
        if not windows:
            kinds = np.bincount(run_a[first_s], minlength=len(n_a))
            here = rec[first_s & (kinds[run_a] > 1)]
            _send(rows, 2, here["block"], here["s"])
        out.append(rec[first_s & (order < 2)])
        again = rec[first_s & (order < 2) & twice]
        again["block"] = _NOWHERE
        out.append(again)
    rec = np.concatenate(out)
    _send(rows, 0, (K.mix(rec["a"]) % _U(shards)).astype(np.int64), rec)


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 8, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, cut_text, removed, *keep): every word in a repeated window goes.

    A window is repeated if its words also start anywhere else.  ``removed``
    holds the maximal repeats as word ranges; ``kept_text`` the other words,
    joined by one space; ``cut_text`` the text without each removed word and the
    blanks after it, null if no word goes.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    job = SubstringDedup(docs, window, gram, block_bytes, id_col, text_col, keep or [])
    scanned = job.scan()
    matched = durable(job.match(scanned).unionByName(scanned.where("side > 0")))
    extended = job.extend(matched)
    windows = job.frequent(extended).unionByName(extended.where("side = 3"))
    out = job.remove(durable(matched.where("side = 1").unionByName(windows)))
    result = ["n_words", "n_removed", "kept_text", "cut_text", "removed"]
    own = {id_col: "doc_id", text_col: "text"}
    others = [F.col(own.get(c, k)).alias(f"{c}_in" if c in ["doc_id", *result] else c) for c, k in job.kept if c != "doc_id" or id_col != "doc_id"]
    return out.select("doc_id", *result, *others)

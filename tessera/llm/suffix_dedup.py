"""Repeated byte strings by prefix-free parsing.

Removes every byte that a string of ``window`` bytes covers which also starts
earlier: in a smaller document, or before in the same one.

Triggers.  Of every window, the ``gram`` bytes with the least rolling hash are its
anchor; windows in a row with one anchor form a stretch.  Equal windows have equal
anchors at equal places, so whole stretches are compared first, and only stretches
that share an anchor but differ need the order of their suffixes.

1.  A scan lists stretches as (anchor, hash of the whole stretch).
2.  By anchor, blocks of documents learn which of their stretches occur elsewhere and
    which share only the anchor with others.
3.  Blocks send the place of the first occurrence they hold of each such stretch, and
    the bytes of those to be ordered.
4.  Of equal stretches the first place stays.  Stretches to be ordered are parsed, by
    shard of anchors: a rolling hash cuts them into phrases that overlap by a trigger,
    so that no phrase's end is the start of another's; suffix arrays of the distinct
    phrases and of the sequence of phrases combine into the order of all suffixes, in
    which equal windows are neighbours (``ordered``).  Neighbours are compared byte
    by byte; of a run, the first place stays.
5.  Blocks remove what has an earlier copy.

Bounds.  Documents are dealt to blocks by a hash of id and text, texts move twice, and
everything else travels as packed records.  A task settles what it can before it sends:
of an equal stretch one record, the first, goes on.  An anchor with more than
``_HERE`` differing stretches in one task, or ``_MOST`` in all, isn't ordered in one
place: the windows of its stretches are dealt to shards by their own hashes, where a
block sends each once.

Whole stretches, and windows of such anchors, count as equal when 64-bit hashes agree
(two of them for windows); ordered windows are compared by their bytes.

Defined cases: a null text is empty; documents shorter than ``window`` bytes lose
nothing; a null id counts as the least; rows that share an id are separate documents,
ordered by a hash of their texts, and of equal rows one comes first; an empty table
gives no rows; other columns are ignored, whatever their names.  A span never joins
two documents.  What remains is bytes, which may cut a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import durable, partitions, releasing

_U = np.uint64
_OPEN = np.dtype([("a", "<u8"), ("s", "<u8"), ("block", "<u4")])
_AT = [("doc", "<u8"), ("tie", "<u8"), ("start", "<u8"), ("block", "<u4")]
_WHOLE = np.dtype([("s", "<u8"), *_AT])
_BYTES = np.dtype([("a", "<u8"), ("s", "<u8"), ("size", "<u4"), *_AT])
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), *_AT])
_SPAN = np.dtype([("s", "<u8"), ("lo", "<u4"), ("hi", "<u4")])
#: Blocks of records that only tell: of a second copy, and of an anchor whose windows are compared by hash.
_NOWHERE, _CROWD = 0xFFFFFFFF, 0xFFFFFFFE
_HERE, _MOST = 64, 4096
#: Stretches that a task settles together, and bytes that are ordered together.
_SETTLE, _TOGETHER = 1 << 20, 4 << 20
_SENT = "side int, target int, data binary, more binary"
#: What a message is: to an anchor's shard; to a block: tell the place, give the bytes, give the windows; to
#: shards: places, bytes, windows; to a block: this stretch has an earlier copy, these parts of it, these windows.
OPEN, TELL, ORDER, SPLIT, PLACES, TEXTS, WINDOWS, LATER, PARTS, GONE = range(10)


def _rolling(buf: np.ndarray, size: int) -> np.ndarray:
    """A cheap hash of the ``size`` bytes (a multiple of 8) from each place on."""
    eight = _eights(buf)
    n = max(0, len(buf) - size + 1)
    h = eight[:n] * _U(0x9E3779B97F4A7C15)
    for k in range(8, size, 8):
        h ^= h >> _U(29)
        h += eight[k : k + n]
        h *= _U(0xD1342543DE82EF95)
    h ^= h >> _U(32)
    return h


def _eights(buf: np.ndarray) -> np.ndarray:
    return np.ndarray(len(buf), "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))


class Stretches:
    """The stretches of some rows of a binary column; ``place`` is counted within the row."""

    def __init__(self, column: pa.Array, window: int, gram: int):
        data, offsets, _ = K.parts(column)
        self.ends = offsets - offsets[0]
        self.buf = data[offsets[0] : offsets[-1]]
        self.window, n = window, len(self.buf)
        self.start = self.length = self.row = np.zeros(0, np.int64)
        self.anchor = self.whole = np.zeros(0, _U)
        size = np.diff(self.ends)
        if n < window or not (size >= window).any():
            return
        low = _U((1 << max(24, n.bit_length())) - 1)
        h = _rolling(self.buf, gram)
        least = K.sliding_min((h & ~low) | np.arange(len(h)).astype(_U), window - gram + 1)
        row = np.repeat(np.arange(len(size)), size)
        valid = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
        anchor = (least[valid] & low).astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        self.start = valid[first]
        self.length = np.diff(np.append(first, len(valid)))
        self.row = row[self.start]
        anchor = anchor[first]
        self.anchor = K.mix(h[anchor])
        self.whole = K.mix(K.hash_bytes(self.buf, self.start, self.start + self.length + window - 1) ^ ((anchor - self.start).astype(_U) * _U(0xE7037ED1A0B428DB)))

    @property
    def place(self) -> np.ndarray:
        return self.start - self.ends[self.row]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, hash, other hash) of all windows of these stretches, in order."""
        n = self.length[which]
        at = np.repeat(self.start[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        half = (self.window + 1) // 2
        ends = K.hash_bytes(self.buf, at, at + half) * _U(0x9E3779B97F4A7C15) + K.hash_bytes(self.buf, at + self.window - half, at + self.window)
        return at, K.hash_bytes(self.buf, at, at + self.window), K.mix(ends)


def _send(rows: list, side: int, targets: np.ndarray, data: np.ndarray, texts: np.ndarray | None = None, size: np.ndarray | None = None) -> None:
    """One row per target with its part of ``data``, and of ``texts``, of which each record has ``size`` bytes."""
    if not len(data):
        return
    order = np.argsort(targets, kind="stable")
    targets, data = targets[order], data[order]
    cut = np.flatnonzero(np.append(True, targets[1:] != targets[:-1]))
    if texts is not None:
        begin = np.append(0, np.cumsum(size))[order]
        raw, ends = texts.tobytes(), (begin + size[order]).tolist()
        begin = begin.tolist()
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(data)).tolist(), strict=True):
        more = None if texts is None else b"".join(raw[begin[k] : ends[k]] for k in range(i, j))
        rows.append((side, int(targets[i]), data[i:j].tobytes(), more))


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["side", "target", "data", "more"])


def _records(table: pa.Table, side: int, kind) -> np.ndarray:
    data, sides = table.column("data").to_pylist(), table.column("side").to_pylist()
    return np.frombuffer(b"".join(d for d, s in zip(data, sides, strict=True) if s == side), kind)


def _first(*columns: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted columns differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(20)) % _U(shards)).astype(np.int64)


def _settle(rows: list, rec: np.ndarray, shards: int) -> None:
    """Decide within a task what can be; ``rec`` holds (a, s, block, doc, tie, start)."""
    rec = rec[np.argsort(rec["s"], kind="stable")]
    new = _first(rec["s"])
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    twice = rec[many]
    twice = twice[np.lexsort((twice["start"], twice["tie"], twice["doc"], twice["s"]))]
    firsts = twice[_first(twice["s"])]
    blocks = twice[np.lexsort((twice["block"], twice["s"]))]
    blocks = blocks[_first(blocks["s"], blocks["block"])]
    _send(rows, TELL, blocks["block"], blocks["s"])
    copies = np.zeros(len(firsts), _OPEN)
    copies["a"], copies["s"], copies["block"] = firsts["a"], firsts["s"], _NOWHERE
    one = np.concatenate([rec[~many], firsts])
    _, which, n = np.unique(one["a"], return_inverse=True, return_counts=True)
    crowd = n[which] > _HERE
    _send(rows, SPLIT, one["block"][crowd], one["s"][crowd])
    told = np.zeros(len(np.unique(one["a"][crowd])), _OPEN)
    told["a"], told["block"] = np.unique(one["a"][crowd]), _CROWD
    rest = np.zeros(int((~crowd).sum()), _OPEN)
    for c in ("a", "s", "block"):
        rest[c] = one[c][~crowd]
    out = np.concatenate([rest, copies, told])
    _send(rows, OPEN, _shard(out["a"], shards), out)


def _refine(rank: np.ndarray, later, most: int, h: int) -> np.ndarray:
    """Ranks (numbers of smaller suffixes) by prefix doubling, from ranks by ``h`` symbols; equal suffixes stay equal.

    ``later(which, h)`` gives the ranks ``h`` places on, -1 beyond the end.
    """
    base = np.int64(len(rank) + 2)
    while h < most:
        tied = np.flatnonzero(np.bincount(rank, minlength=len(rank) + 1)[rank] > 1)
        if not len(tied):
            break
        key = rank[tied] * base + later(rank, tied, h) + 1
        order = np.argsort(key, kind="stable")
        key, group = key[order], rank[tied][order]
        at = np.arange(len(key))
        new, head = _first(key), _first(group)
        rank[tied[order]] = group + at[np.maximum.accumulate(np.where(new, at, 0))] - at[np.maximum.accumulate(np.where(head, at, 0))]
        h *= 2
    return rank


def ordered(buf: np.ndarray, ends: np.ndarray, window: int, period: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of these strings in suffix order, number of the run of equal windows each is in).

    String k is buf[ends[k]:ends[k + 1]].  A phrase goes from one trigger, 8 bytes
    whose hash is 0 modulo ``period``, to the end of the next.
    """
    eight = _eights(buf)
    trigger = np.zeros(len(buf), bool)
    trigger[: max(0, len(buf) - 7)] = K.mix(_rolling(buf, 8)) % _U(period) == 0
    for k in range(1, 8):
        trigger[ends[1:][ends[1:] >= k] - k] = False  # needs 8 bytes of its string
    trigger[ends[:-1][np.diff(ends) > 0]] = True
    start = np.flatnonzero(trigger)
    string = np.searchsorted(ends, start, "right") - 1
    last = np.append(string[1:] != string[:-1], True)
    stop = np.where(last, ends[string + 1], np.append(start[1:], 0) + 8)
    # the dictionary: distinct phrases, and the ranks of all their suffixes
    _, pick, phrase = np.unique(K.hash_bytes(buf, start, stop), return_index=True, return_inverse=True)
    size = (stop - start)[pick]
    base = np.append(0, np.cumsum(size))
    text = np.repeat(start[pick] - base[:-1], size) + np.arange(base[-1])
    left = np.repeat(base[1:], size) - np.arange(base[-1])
    head = eight[text].byteswap() >> _U(8)
    short = left < 7
    head[short] &= ~((_U(1) << (_U(8) * (7 - left[short]).astype(_U))) - _U(1))
    head = (head << _U(8)) | np.minimum(left, 7).astype(_U)
    _, rank, n = np.unique(head, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n)[rank]

    def within(rank, which, h):
        return np.where(left[which] > h, rank[np.minimum(which + h, len(rank) - 1)], -1)

    rank = _refine(rank, within, int(size.max(initial=0)), 7)
    # the parse: ranks of the sequences of phrases
    count = len(start)
    line = string.copy()
    symbols, parse = np.unique(rank[base[:-1][phrase]], return_inverse=True)
    order = np.bincount(parse, minlength=len(symbols))
    parse = (np.cumsum(order) - order)[parse]

    def along(rank, which, h):
        to = np.minimum(which + h, count - 1)
        return np.where((which + h < count) & (line[to] == line[which]), rank[to], -1)

    parse = _refine(parse, along, int(np.bincount(line).max(initial=0)), 1)
    # both: a suffix is a phrase's suffix and the phrases after it
    whole = np.diff(ends) >= window
    n = np.where(whole, np.diff(ends) - window + 1, 0)
    at = np.repeat(ends[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    j = np.searchsorted(start, at, "right") - 1
    after = np.where(last[j], -1, parse[np.minimum(j + 1, count - 1)]) if count else j
    at = at[np.argsort(rank[base[:-1][phrase[j]] + at - start[j]] * np.int64(count + 2) + after + 1, kind="stable")] if count else at
    same = np.zeros(len(at), bool)
    if len(at):
        same[1:] = True
        for k in [*range(0, window - 7, 8), window - 8]:
            x = eight[at + k]
            same[1:] &= x[1:] == x[:-1]
    return at, np.cumsum(~same) - 1


def _ordered_parts(rows: list, rec: np.ndarray, raw: np.ndarray, window: int) -> None:
    """Tell blocks which windows of their stretches start earlier elsewhere."""
    begin = np.append(0, np.cumsum(rec["size"].astype(np.int64)))[:-1]
    order = np.lexsort((rec["start"], rec["tie"], rec["doc"], rec["s"], rec["a"]))
    rec, begin = rec[order], begin[order]
    keep = _first(rec["a"], rec["s"])
    rec, begin = rec[keep], begin[keep]
    heads = np.append(np.flatnonzero(_first(rec["a"])), len(rec))
    size = rec["size"].astype(np.int64)
    total = np.append(0, np.cumsum(size))
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(total[heads], total[heads[i]] + _TOGETHER, "right")) - 1)
        a, b = heads[i], heads[j]
        i, part, n = j, rec[a:b], size[a:b]
        ends = np.append(0, np.cumsum(n))
        buf = raw[np.repeat(begin[a:b] - ends[:-1], n) + np.arange(ends[-1])]
        at, run = ordered(buf, ends, window)
        which = np.searchsorted(ends, at, "right") - 1
        often = np.bincount(run, minlength=1)[run] > 1
        at, run, which = at[often], run[often], which[often]
        inner = at - ends[which]
        o = np.lexsort((part["start"][which] + inner.astype(_U), part["tie"][which], part["doc"][which], run))
        later = o[~_first(run[o])]
        if not len(later):
            continue
        at = np.sort(at[later])
        which = np.searchsorted(ends, at, "right") - 1
        cut = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])))
        spans = np.zeros(len(cut), _SPAN)
        which = which[cut]
        spans["s"], spans["lo"] = part["s"][which], at[cut] - ends[which]
        spans["hi"] = at[np.append(cut[1:], len(at)) - 1] - ends[which] + 1
        _send(rows, PARTS, part["block"][which], spans)


class _Block:
    """A block's documents in order, and their stretches."""

    def __init__(self, docs: pa.Table, window: int, gram: int):
        doc, tie = docs.column("doc").to_numpy().view("<u8"), docs.column("tie").to_numpy().view("<u8")
        self.order = np.lexsort((tie, doc))
        self.doc, self.tie = doc[self.order], tie[self.order]
        self.text = docs.column("text").combine_chunks().take(pa.array(self.order))
        self.parts = [(i, Stretches(self.text[i:j], window, gram)) for i, j in K.slices(self.text)]
        join = lambda f: np.concatenate([f(i, x) for i, x in self.parts]) if self.parts else np.zeros(0, np.int64)
        self.row, self.place, self.length = join(lambda i, x: x.row + i), join(lambda i, x: x.place), join(lambda i, x: x.length)
        self.whole, self.anchor = join(lambda i, x: x.whole).astype(_U), join(lambda i, x: x.anchor).astype(_U)
        self.part = np.repeat(np.arange(len(self.parts)), [len(x.start) for _, x in self.parts])
        self.begin = np.append(0, np.cumsum([len(x.start) for _, x in self.parts]))
        # stretches are in the order of rows and places, so a stable sort finds the first of each
        o = np.argsort(self.whole, kind="stable")
        self.is_first = np.zeros(len(o), bool)
        self.is_first[o[_first(self.whole[o])]] = True

    def at(self, which: np.ndarray, kind: np.dtype, block: int, offset=0) -> np.ndarray:
        rec = np.zeros(len(which), kind)
        row = self.row[which]
        rec["doc"], rec["tie"], rec["start"], rec["block"] = self.doc[row], self.tie[row], self.place[which] + offset, block
        return rec

    def windows(self, which: np.ndarray):
        """(stretch, offset in it, hash, other hash) of each window of these stretches, in order."""
        out = []
        for k, (_, x) in enumerate(self.parts):
            mine = which[self.part[which] == k]
            if len(mine):
                at, h, g = x.windows(mine - self.begin[k])
                of = np.repeat(mine, self.length[mine])
                out.append((of, at - x.start[of - self.begin[k]], h, g))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)]

    def bytes(self, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        size, out = self.length[which] + window - 1, []
        for k, (_, x) in enumerate(self.parts):
            mine = which[self.part[which] == k] - self.begin[k]
            n = x.length[mine] + window - 1
            out.append(x.buf[np.repeat(x.start[mine] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(mine) else np.zeros(0, np.uint8))
        return np.concatenate(out) if out else np.zeros(0, np.uint8), size


class SuffixDedup:
    """The passes over one table."""

    def __init__(self, docs: DataFrame, window: int, gram: int, block_bytes: int, id_col: str, text_col: str):
        self.window, self.gram = window, gram
        text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
        docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = int(max(partitions(docs.sparkSession), 1 + total // block_bytes))
        # as unsigned numbers these ids are in order, null first
        place = F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63))), F.lit(0).cast("long"))
        self.docs = docs.withColumn("doc", place).withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(self.blocks)).cast("int"))

    def scan(self) -> DataFrame:
        window, gram, shards = self.window, self.gram, self.blocks
        kind = np.dtype([*_OPEN.descr, ("doc", "<u8"), ("tie", "<u8"), ("start", "<u8")])

        def run(batches):
            held: list = []

            def settled():
                rows: list = []
                _settle(rows, np.concatenate(held), shards)
                held.clear()
                return _batch(rows)

            for batch in batches:
                text, block, doc, tie = batch.column(0), *(batch.column(k).to_numpy() for k in (1, 2, 3))
                for i, j in K.slices(text):
                    x = Stretches(text[i:j], window, gram)
                    rec = np.zeros(len(x.whole), kind)
                    rec["a"], rec["s"], rec["block"], rec["start"] = x.anchor, x.whole, block[i:j][x.row], x.place
                    rec["doc"], rec["tie"] = doc[i:j].view("<u8")[x.row], tie[i:j].view("<u8")[x.row]
                    held.append(rec)
                    if sum(map(len, held)) >= _SETTLE:
                        yield settled()
            if sum(map(len, held)):
                yield settled()

        return durable(self.docs.select("text", "block", "doc", "tie").mapInArrow(releasing(run), _SENT))

    def match(self, sent: DataFrame) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            rec, rows = _records(table, OPEN, _OPEN), []
            rec = rec[np.lexsort((rec["block"], rec["s"], rec["a"]))]
            stretch, anchor = np.cumsum(_first(rec["a"], rec["s"])) - 1, np.cumsum(_first(rec["a"])) - 1
            real = rec["block"] < _CROWD
            copies = np.bincount(stretch)[stretch] > 1
            crowd = np.bincount(anchor, rec["block"] == _CROWD)[anchor] > 0
            kinds = np.bincount(anchor, _first(rec["a"], rec["s"]) & (rec["block"] != _CROWD))[anchor]
            crowd |= kinds > _MOST
            new = real & _first(rec["a"], rec["s"], rec["block"])
            for side, mask in ((TELL, new & copies), (ORDER, new & (kinds > 1) & ~crowd), (SPLIT, new & crowd)):
                _send(rows, side, rec["block"][mask], rec["s"][mask])
            return pa.Table.from_batches([_batch(rows)])

        return durable(sent.where(F.col("side") == OPEN).groupBy("target").applyInArrow(run, _SENT).unionByName(sent.where(F.col("side") > OPEN)))

    def per_block(self, run, told: DataFrame, schema: str) -> DataFrame:
        left = self.docs.select("block", "doc_id", "doc", "tie", "text").groupBy("block")
        right = told.select(F.col("target").alias("block"), "side", "data")
        return left.cogroup(right.groupBy("block")).applyInArrow(run, schema)

    def probe(self, told: DataFrame) -> DataFrame:
        window, gram, shards = self.window, self.gram, self.blocks

        def run(docs: pa.Table, told: pa.Table) -> pa.Table:
            rows: list = []
            if docs.num_rows and told.num_rows:
                block, b = docs.column("block")[0].as_py(), _Block(docs, window, gram)
                tell, order, split = (np.flatnonzero(b.is_first & np.isin(b.whole, _records(told, k, "<u8"))) for k in (TELL, ORDER, SPLIT))
                rec = b.at(tell, _WHOLE, block)
                rec["s"] = b.whole[tell]
                _send(rows, PLACES, _shard(rec["s"], shards), rec)
                rec = b.at(order, _BYTES, block)
                raw, size = b.bytes(order, window)
                rec["a"], rec["s"], rec["size"] = b.anchor[order], b.whole[order], size
                _send(rows, TEXTS, _shard(rec["a"], shards), rec, raw, size)
                of, offset, h, g = b.windows(split)
                rec = b.at(of, _WINDOW, block, offset)
                rec["h"], rec["g"] = h, g
                o = np.lexsort((g, h))
                rec = rec[o[_first(h[o], g[o])]]
                _send(rows, WINDOWS, _shard(rec["h"], shards), rec)
            return pa.Table.from_batches([_batch(rows)])

        return durable(self.per_block(run, told, _SENT))

    def resolve(self, sent: DataFrame) -> DataFrame:
        window = self.window

        def run(table: pa.Table) -> pa.Table:
            rows: list = []
            rec = _records(table, PLACES, _WHOLE)
            rec = rec[np.lexsort((rec["start"], rec["tie"], rec["doc"], rec["s"]))]
            later = ~_first(rec["s"])
            _send(rows, LATER, rec["block"][later], rec["s"][later])
            rec = _records(table, WINDOWS, _WINDOW)
            rec = rec[np.lexsort((rec["start"], rec["tie"], rec["doc"], rec["g"], rec["h"]))]
            later = ~_first(rec["h"], rec["g"])
            _send(rows, GONE, rec["block"][later], rec["h"][later] ^ rec["g"][later])
            rec = _records(table, TEXTS, _BYTES)
            if len(rec):
                raw = np.frombuffer(b"".join(x for x, s in zip(table.column("more").to_pylist(), table.column("side").to_pylist(), strict=True) if s == TEXTS), np.uint8)
                _ordered_parts(rows, rec, raw, window)
            return pa.Table.from_batches([_batch(rows)])

        return sent.groupBy("side", "target").applyInArrow(run, _SENT)

    def remove(self, told: DataFrame) -> DataFrame:
        window, gram = self.window, self.gram

        def run(docs: pa.Table, told: pa.Table) -> pa.Table:
            ids, n_bytes, n_removed, kept, spans = [], [], [], [], []
            if docs.num_rows:
                b = _Block(docs, window, gram)
                ends = np.append(0, np.cumsum([x.buf.size for _, x in b.parts]))
                edge = np.zeros(ends[-1] + 1, np.int32)
                start = np.concatenate([x.start + ends[k] for k, (_, x) in enumerate(b.parts)])
                later = np.isin(b.whole, _records(told, LATER, "<u8"))
                gone = np.flatnonzero(~b.is_first | later)
                np.add.at(edge, start[gone], 1)
                np.add.at(edge, start[gone] + b.length[gone] + window - 1, -1)
                part, firsts = _records(told, PARTS, _SPAN), np.flatnonzero(b.is_first)
                firsts = firsts[np.argsort(b.whole[firsts], kind="stable")]
                of = firsts[np.searchsorted(b.whole[firsts], part["s"])] if len(part) else np.zeros(0, np.int64)
                np.add.at(edge, start[of] + part["lo"], 1)
                np.add.at(edge, start[of] + part["hi"] + window - 1, -1)
                of, offset, h, g = b.windows(np.flatnonzero(b.is_first & np.isin(b.whole, _records(told, SPLIT, "<u8"))))
                o = np.lexsort((g, h))
                again = np.zeros(len(o), bool)
                again[o[~_first(h[o], g[o])]] = True
                again |= np.isin(h ^ g, _records(told, GONE, "<u8"))
                np.add.at(edge, start[of[again]] + offset[again], 1)
                np.add.at(edge, start[of[again]] + offset[again] + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                ids = docs.column("doc_id").combine_chunks().take(pa.array(b.order))
                for k, (_, x) in enumerate(b.parts):
                    mask = covered[ends[k] : ends[k + 1]]
                    removed = np.append(0, np.cumsum(mask))
                    raw = x.buf.tobytes()
                    for i, j, m in zip(x.ends[:-1].tolist(), x.ends[1:].tolist(), np.diff(removed[x.ends]).tolist(), strict=True):
                        cuts = np.flatnonzero(np.diff(np.concatenate(([0], mask[i:j].view(np.int8), [0])))).tolist() if m else []
                        keep, at = [], i
                        for p, q in zip(cuts[::2], cuts[1::2], strict=True):
                            keep.append(raw[at : i + p])
                            at = i + q
                        kept.append(b"".join([*keep, raw[at:j]]))
                        n_bytes.append(j - i)
                        n_removed.append(m)
                        spans.append([{"start": p, "length": q - p} for p, q in zip(cuts[::2], cuts[1::2], strict=True)])
            kind = docs.schema.field("doc_id").type
            return pa.table({"doc_id": pa.array(ids, kind) if isinstance(ids, list) else ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))})

        return self.per_block(run, told, f"doc_id {dict(self.docs.dtypes)['doc_id']}, n_bytes long, n_removed long, kept binary, removed array<struct<start: long, length: long>>")


def suffix_dedup(docs: DataFrame, window: int = 100, gram: int = 32, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, removed): the bytes that stay, and the maximal runs of those that go.

    ``id_col`` holds whole numbers; ``gram`` is a multiple of 8 and at most ``window``.
    """
    if gram % 8 or not 8 <= gram <= window or window < 16:
        raise ValueError("gram must be a multiple of 8, at most window; window 16 or more")
    job = SuffixDedup(docs, window, gram, block_bytes, id_col, text_col)
    told = job.match(job.scan())
    solved = job.resolve(job.probe(told))
    return job.remove(durable(solved.unionByName(told.where(F.col("side") == SPLIT))))

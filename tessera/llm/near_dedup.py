"""Near-duplicate components by an LSH forest.

Each document's distinct word shingles get a MinHash signature.  Documents with
equal sets are one class, and a tree of the forest sorts the classes by a few
signature values of its own, then by four bits of every value, beginning with the
tree's.  So the neighbours of a class are those with the longest common prefix, and
the depth of a comparison adapts: where few classes share a tree's first ``BASE``
values all of them meet, and where many do the next ones have more in common.

1.  Every class links to its best of ``_NEAR`` neighbours in each tree; links are
    confirmed on full sets, and components found.
2.  A region (the classes of a tree with one base prefix) of ``_FAR`` + 1 or fewer
    is compared completely: sorted neighbours of different components.
3.  A larger region with more than one component, of which up to ``_TILE`` classes lie
    outside its most frequent one, is compared completely too, without the pairs inside
    that component: its members and the others are dealt into tiles of about
    ``_TILE``, and every two tiles that hold an open pair meet in a task, which compares
    signatures, then full sets, and returns only links that join components.
4.  A region with more classes outside goes deeper (``deeper``): what its classes have
    in common tells nothing, so they are parted by their rarest shingles.  The
    parts are regions of their own, for which steps 2 and 3 are repeated, unless
    their squares are more than the complete comparison costs.

So a linked group of any size costs about one link a member and tree, and o members
of other components among n in a region cost o * n comparisons, o being at most
``_TILE``.  A deeper part is as large as a shingle is frequent that is among the rarest
ninth to fifth of a set: classes of one family, alike in up to about three quarters
and linked with nothing, have none in common there.  Where even the rarest shingles are
frequent (slots of a template filled from few words), the square of a region remains.

With trees of base depth 2, a pair of similarity s shares no tree's prefix with
probability (1 - s**2)**trees: 6e-7 at 0.8 with 14 trees; all other pairs are
compared.  Full sets are compared only if at least ``agree`` of 224 four-bit
signature values agree; a pair of similarity 0.8, of which 182 agree on average,
fails that with a probability of about 1e-6.

Defined cases: null, empty and blank texts have empty sets and link with
nothing; texts with fewer words than a shingle have one shingle, the whole
sequence; each row is judged by its own text, also where rows share a doc_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import attach_by_group, components, durable, partitions, releasing, small

_U = np.uint64
TREES, DEPTH, BASE = 14, 4, 2
_KEYS, _HASHES = TREES * DEPTH, 224
_MUL = K.mix(np.arange(1, _HASHES + 1, dtype=_U)) | _U(1)
_NEAR, _FAR = 4, 64
#: Rows and shingles of a tile, about.
_TILE, _TILE_SIZE = 1024, 2 << 20
#: Sizes of sets in one band differ by this factor at most.
_BAND = 1.04


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of the rows, a list for each slice of them."""
    for i, j in K.slices(column, 4 << 20):
        data, offsets, _ = K.parts(column[i:j])
        h, ends = K.words(data, offsets, lower=True)
        runs, out = K.Runs(h), []
        grams = runs.of(np.arange(max(0, len(h) - size + 1)), size)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(grams[a : b - size + 1]))
            else:
                out.append(runs.of(np.array([a]), b - a) if b > a else np.zeros(0, _U))
        yield out


def digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signature(values: np.ndarray) -> np.ndarray:
    out = np.full(_HASHES, 0xFFFFFFFF, _U)
    for i in range(0, len(values), 2048):
        x = values[i : i + 2048, None] * _MUL
        out = np.minimum(out, (x >> _U(32)).min(axis=0))
    return out.astype(np.uint32)


def packed(sig: np.ndarray) -> tuple[bytes, bytes]:
    """The trees' values, most significant byte first, and four bits of every value."""
    low = (sig & 15).astype(np.uint8)
    return sig[:_KEYS].astype(">u4").tobytes(), (low[::2] << 4 | low[1::2]).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig, mark) of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            i = 0
            for sets in shingle_sets(batch.column(1), size):
                sigs = [packed(signature(x)) if len(x) else (None, None) for x in sets]
                arrays = [pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), *(pa.array([x[k] for x in sigs], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + len(sets)], *arrays], ["doc_id", "n_shingles", "set_id", "sig", "mark"])
                i += len(sets)

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n_shingles long, set_id binary, sig binary, mark binary")


def trees(classes: DataFrame) -> DataFrame:
    """Rows (tree, key, node, mark, comp), one for each class and tree.

    ``key`` holds the tree's own signature values, most significant first, and
    ``mark`` four bits of every value.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), ">u4").reshape(-1, _KEYS)
            for t in range(TREES):
                keys = pa.array([k.tobytes() for k in sig[:, t * DEPTH : (t + 1) * DEPTH]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), keys, *(batch.column(c) for c in ("node", "mark", "comp"))], ["tree", "key", "node", "mark", "comp"])

    return classes.select("node", "sig", "mark", "comp").mapInArrow(releasing(run), "tree int, key binary, node long, mark binary, comp long")


def _order() -> list[Column]:
    """Tree, its values, then four bits of all values from the tree's on, and round again."""
    at = F.col("tree") * (DEPTH // 2)
    return [F.col("tree"), F.col("key"), F.concat(F.substring("mark", at + 1, F.lit(_HASHES)), F.substring("mark", F.lit(1), at)), F.col("node")]


def forest(rows: DataFrame) -> DataFrame:
    """The rows of ``trees``, sorted within range partitions."""
    n = partitions(rows.sparkSession)
    return rows.select("tree", "key", "node", "mark", "comp").repartitionByRange(n, *_order()).sortWithinPartitions(*_order())


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return ((x & 0xF0) == 0).sum(axis=1) + ((x & 0x0F) == 0).sum(axis=1)


def neighbours(rows: DataFrame, agree: int, reach: int, best_only: bool) -> DataFrame:
    """Candidates (a, b, same) among sorted rows of different ``comp``.

    Each row is compared with up to ``reach`` rows before it that share the base
    prefix; ``best_only`` keeps the one that agrees most.  Side rows carry the
    partition's first and last rows, so that neighbours across partitions meet.
    """

    def pairs(tree, key, doc, mark, comp):
        n = len(doc)
        if n < 2:
            return [], [], []
        prefix = key[:, :BASE]
        out_a, out_b, out_s = [], [], []
        best, partner = np.full(n, -1), np.zeros(n, np.int64)
        alive = np.arange(1, n)
        for k in range(1, min(reach, n - 1) + 1):
            alive = alive[alive >= k]
            j = alive - k
            near = (tree[alive] == tree[j]) & (prefix[alive] == prefix[j]).all(axis=1)
            alive, j = alive[near], j[near]
            if not len(alive):
                break
            other = comp[alive] != comp[j]
            i, j = alive[other], j[other]
            same = _agreement(mark[i], mark[j])
            ok = same >= agree
            i, j, same = i[ok], j[ok], same[ok]
            if best_only:
                better = same > best[i]
                best[i[better]], partner[i[better]] = same[better], j[better]
            else:
                out_a.append(doc[i]), out_b.append(doc[j]), out_s.append(same)
        if best_only:
            i = np.flatnonzero(best >= 0)
            return [doc[i]], [doc[partner[i]]], [best[i]]
        return out_a, out_b, out_s

    def unpack(batch):
        return (
            batch.column("tree").to_numpy(),
            np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, DEPTH),
            batch.column("node").to_numpy(),
            np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint8).reshape(-1, _HASHES // 2),
            batch.column("comp").to_numpy(),
        )

    def slide(batches, edges):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = unpack(batch)
            if held is not None:
                now = tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
            elif edges:
                yield _border(tuple(x[:reach] for x in now))
            a, b, s = pairs(*now)
            a, b, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, s))
            if len(a):
                yield _pairs(a, b, s)
            held = tuple(x[-reach:] for x in now)
        if held is not None and edges:
            yield _border(held)

    schema = "a long, b long, same long, tree int, key binary, mark binary, comp long"
    found = durable(rows.mapInArrow(releasing(lambda batches: slide(batches, True)), schema))
    border = found.where("tree is not null").select("tree", "key", F.col("a").alias("node"), "mark", "comp").distinct()

    # At most 2 * reach rows a range partition and its neighbours in other ones; those of a region meet in one task.
    n = partitions(rows.sparkSession)
    met = border.repartition(n, "tree", F.substring("key", 1, 4 * BASE)).sortWithinPartitions(*_order()).mapInArrow(releasing(lambda batches: slide(batches, False)), schema)
    both = found.where("tree is null").unionByName(met)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").where("a <> b").groupBy("a", "b").agg(F.max("same").alias("same"))


_NAMES = ["a", "b", "same", "tree", "key", "mark", "comp"]


def _pairs(a, b, s):
    none = pa.nulls(len(a))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.int64)), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary()), none.cast(pa.int64())], _NAMES)


def _border(rows):
    tree, key, doc, mark, comp = rows
    none = pa.nulls(len(doc)).cast(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(doc), none, none, pa.array(tree), pa.array([k.tobytes() for k in key], pa.binary()), pa.array([m.tobytes() for m in mark], pa.binary()), pa.array(comp)], _NAMES)


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, set): the full set of each of ``classes`` (node, doc_id, set_id)."""

    def run(batches):
        for batch in batches:
            i = 0
            for sets in shingle_sets(batch.column(1), size):
                arrays = [batch.column(0)[i : i + len(sets)], pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "set_id", "set"])
                i += len(sets)

    classes = small(classes.select("node", "doc_id", "set_id"))
    found = docs.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, set_id binary, set array<long>")
    return durable(found.join(classes, ["doc_id", "set_id"]).select("node", "set").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union."""
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = full_sets(docs, classes.join(used, "node", "left_semi"), size)
    left = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return left.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _alike(mark: np.ndarray, a: np.ndarray, b: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``a`` and ``b`` that agree in so many of the four-bit values."""
    out = [], []
    for i in range(0, len(a), 128):
        part = a[i : i + 128]
        same = np.zeros((len(part), len(b)), np.int16)
        for k in range(0, mark.shape[1], 16):
            x = mark[part, None, k : k + 16] ^ mark[None, b, k : k + 16]
            same += ((x & 0xF0) == 0).sum(axis=2, dtype=np.int16)
            same += ((x & 0x0F) == 0).sum(axis=2, dtype=np.int16)
        p, q = np.nonzero(same >= agree)
        out[0].append(part[p]), out[1].append(b[q])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def _common(values: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair."""
    rows = np.unique(np.concatenate([i, j]))
    held, inverse, counts = np.unique(np.concatenate([values[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = counts > 1
    if len(i) * 20e-6 < len(rows) ** 2 * int(shared.sum()) / 4e10:
        return np.array([len(np.intersect1d(values[x], values[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # Many pairs of few rows: products of rows of 0 and 1, some columns at a time.
    row = np.repeat(np.arange(len(rows)), [len(values[r]) for r in rows])
    at = shared[inverse]
    row, column = row[at], (np.cumsum(shared) - 1)[inverse[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = np.zeros((len(rows), len(rows)), np.float32), 4096
    for start in range(0, int(shared.sum()), width):
        p, q = np.searchsorted(column, [start, start + width])
        x = np.zeros((len(rows), width), np.float32)
        x[row[p:q], column[p:q] - start] = 1
        total += x @ x.T
    return total[np.searchsorted(rows, i), np.searchsorted(rows, j)].astype(np.int64)


def _joining(node: np.ndarray, comp: np.ndarray, mark: np.ndarray, values: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, agree: int) -> list[tuple[int, int]]:
    """Linked pairs of rows of ``left`` and ``right`` that join all components which such pairs join."""
    i, j = _alike(mark, left, right, agree)
    open_ = comp[i] != comp[j]
    i, j = i[open_], j[open_]
    if not len(i):
        return []
    both, size = _common(values, i, j), np.array([len(x) for x in values])
    linked = 100 * both >= percent * (size[i] + size[j] - both)
    i, j = i[linked], j[linked]
    group: dict[int, int] = {}

    def top(c):
        while group.setdefault(c, c) != c:
            group[c] = c = group[group[c]]
        return c

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = top(int(comp[x])), top(int(comp[y]))
        if p != q:
            group[p] = q
            out.append((int(node[x]), int(node[y])))
    return out


def tiled(rows: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, agree: int) -> DataFrame:
    """Links (a, b) of nodes that join the components of each region, all its open pairs compared.

    ``rows`` are (tree, base, node, mark, comp, main, n_main, n_other, size_main,
    size_other): the region's most frequent component, and the rows and shingles
    in it and outside.
    """

    def run(table):
        table = table.combine_chunks()
        node, comp, tile = (table.column(k).to_numpy() for k in ("node", "comp", "tile"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        found = []
        if (comp != comp[0]).any():
            mark = np.frombuffer(b"".join(table.column("mark").to_pylist()), np.uint8).reshape(len(node), -1)
            sets = table.column("set").combine_chunks()
            at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            values = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = _joining(node, comp, mark, values, np.flatnonzero(tile == low), np.flatnonzero(tile == high), percent, agree)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    used = rows.select("node").distinct()
    sets = full_sets(docs, classes.join(used, "node", "left_semi"), size)
    tiles = lambda n, total: F.ceil(F.greatest(F.col(n) / _TILE, F.col(total) / _TILE_SIZE, F.lit(1))).cast("long")
    others, mains, is_main = tiles("n_other", "size_other"), tiles("n_main", "size_main"), F.col("comp") == F.col("main")
    # Tiles of the others come first; these meet all tiles, those of the main component only the others'.
    rows = rows.withColumn("tile", F.when(is_main, others + F.pmod(F.xxhash64("node"), mains)).otherwise(F.pmod(F.xxhash64("node"), others)))
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, others).otherwise(others + mains) - 1)))
    rows = rows.select("tree", "base", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "node", "mark", "comp", "tile")
    pair = ["tree", "base", "low", "high"]
    dealt = rows.join(sets, "node").repartitionByRange(partitions(rows.sparkSession), *pair)
    return dealt.groupBy(*pair).applyInArrow(run, "a long, b long")


def outside(rows: DataFrame) -> DataFrame:
    """For each region (tree, base): its main component, and rows and shingles in it and outside."""
    parts = rows.groupBy("tree", "base", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    sums = parts.groupBy("tree", "base").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    return sums.select("tree", "base", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"), (F.col("n") - F.col("top.n")).alias("n_other"), F.col("top.size").alias("size_main"), (F.col("size") - F.col("top.size")).alias("size_other"))


def deeper(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (tree, base, node, comp, n_shingles): the classes of ``crowd`` by their rarest shingles.

    Two sets that overlap in o or more shingles have one in common among the first
    size - o + 1 of each, in any order of all shingles; here the rarest come first.
    What o must be depends on both sizes, so sets meet by bands of sizes: ``tree`` stands
    for a pair of bands, and ``base`` for a shingle.
    """
    shingles = sets.select("node", F.explode("set").alias("shingle"))
    often = durable(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    # Shingles of one class alone are the rarest: only their number counts.
    shared = attach_by_group(shingles, often, "shingle", "n").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))
    n = F.col("n_shingles")
    least, most = F.ceil(n * percent / 100), F.floor(n * 100 / percent)

    def band(size):
        return F.floor(F.log(size) / math.log(_BAND)).cast("int")

    def with_partner(other):
        smallest = F.greatest(F.ceil(F.pow(F.lit(_BAND), other) - 1e-6), least)
        prefix = n - F.ceil((n + smallest) * percent / (100 + percent)) + 1
        return F.struct(other.alias("band"), (prefix - n + F.size("shared")).cast("int").alias("first"))

    partners = F.filter(F.transform(F.sequence(band(least), band(most)), with_partner), lambda x: x["first"] > 0)
    rows = shared.join(crowd, "node").select("node", "comp", "n_shingles", "shared", band(n).alias("band"), F.explode(partners).alias("x"))
    rows = rows.select("node", "comp", "n_shingles", (F.least("band", "x.band") * 2048 + F.greatest("band", "x.band")).alias("tree"), F.explode(F.slice("shared", 1, F.col("x.first"))).alias("y"))
    return rows.select("tree", F.unhex(F.lpad(F.hex("y.shingle"), 16, "0")).alias("base"), "node", "comp", "n_shingles")


def near_dedup(docs: DataFrame, size: int = 4, percent: int = 80, agree: int = 153, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): linked are pairs with a Jaccard similarity of ``percent`` or more.

    ``component_id`` is the smallest doc_id that links reach.  Words are lower-cased
    in A-Z only.  doc_id must be a non-null long.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = durable(signatures(docs, size))
    full = sigs.where("n_shingles > 0")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("mark").alias("mark"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    # Written at once, so each class keeps its number.
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))

    def labelled(links):
        if links is None:
            return classes.withColumn("comp", F.col("node"))
        known = components(links).withColumnRenamed("component", "comp")
        return classes.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def links_of(candidates):
        return durable(confirmed(durable(candidates), docs, classes, size, percent))

    best = neighbours(forest(trees(labelled(None))), agree, _NEAR, True)
    links = links_of(best.groupBy("b").agg(F.max(F.struct("same", "a")).alias("x")).select("b", F.col("x.a").alias("a")).select("a", "b"))

    marked = durable(labelled(links))
    rows = trees(marked).withColumn("base", F.substring("key", 1, 4 * BASE))
    regions = durable(rows.groupBy("tree", "base").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where(F.col("n") > _FAR + 1))
    dense = small(regions.select("tree", "base"))
    new = links_of(neighbours(forest(rows.join(dense, ["tree", "base"], "left_anti")), agree, _FAR, False).select("a", "b"))
    links = durable(links.unionByName(new))

    split = small(regions.where("least <> most").select("tree", "base"))
    rows = trees(durable(labelled(links))).withColumn("base", F.substring("key", 1, 4 * BASE)).join(split, ["tree", "base"], "left_semi")
    rows = durable(rows.join(classes.select("node", "n_shingles"), "node").select("tree", "base", "node", "mark", "comp", "n_shingles"))
    sums = durable(outside(rows).where("n_other > 0"))
    few = rows.join(small(sums.where(F.col("n_other") <= _TILE)), ["tree", "base"])
    links = links.unionByName(durable(tiled(few, docs, classes, size, percent, agree)))

    wide = small(sums.where(F.col("n_other") > _TILE))
    cost = wide.agg(F.sum(F.col("n_other").cast("double") * (F.col("n_main") + F.col("n_other")))).first()[0]
    if cost:
        crowd = durable(rows.join(wide.select("tree", "base"), ["tree", "base"], "left_semi").select("node", "comp", "n_shingles").distinct())
        parts = durable(deeper(crowd, full_sets(docs, classes.join(crowd, "node", "left_semi"), size), percent))
        counts = durable(parts.groupBy("tree", "base").agg(F.count("*").alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("tree", "base", "n"))
        if (counts.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) < cost:
            rows = durable(attach_by_group(parts, counts, ["tree", "base"], "n").join(classes.select("node", "mark"), "node"))
            near = rows.where(F.col("n") <= _FAR + 1).withColumn("key", F.concat("base", F.lit(bytes(4 * (DEPTH - BASE)))))
            links = links.unionByName(links_of(neighbours(forest(near), agree, _FAR, False).select("a", "b")))
            large = durable(rows.where(F.col("n") > _FAR + 1))
            pairs = large.join(small(outside(large)), ["tree", "base"])
        else:
            pairs = rows.join(wide, ["tree", "base"])
        links = links.unionByName(durable(tiled(pairs, docs, classes, size, percent, agree)))

    known = components(links).withColumnRenamed("component", "comp")
    labels = durable(classes.join(known, "node", "left").select("set_id", "n", "doc_id", F.coalesce("comp", "node").alias("comp")))
    least = durable(labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")))
    labels = durable(attach_by_group(labels, least, "comp", "members").select("set_id", "n", "component_id"))
    out = attach_by_group(full.select("doc_id", "n_shingles", "set_id"), labels, "set_id", "n").select("doc_id", "n_shingles", "component_id")
    bare = sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(bare).withColumn("kept", F.col("doc_id") == F.col("component_id"))

"""Full-text retrieval: postings, phrase match, BM25, ranks and their fusion.

A query is a list of phrases, all of which must match; a phrase is a list of
tokens that stand side by side in one column.  ``scan`` finds them in texts,
``lookup`` in written postings; both give one row per matching document with its
length and the phrases' counts, and share the rest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_table, find_tokens, fold_tables, let, tokenize, tokens

# Fixed values of the scoring.
K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 1e-6, 60
#: More candidates than this in one source are an error, never cut.
MAX_CANDIDATES = 10_000
#: When postings are written, a task sorts at a time documents of this many tokens, and at most this many documents or bytes more.
RUN, STEP, STEP_BYTES = 2_000_000, 512, 1 << 22


class QueryError(ValueError):
    """A query that can't be answered."""


@dataclass(frozen=True)
class Stats:
    """What scores need from the whole index: rows, tokens, and the rows of each phrase."""

    rows: int
    tokens: int
    with_phrase: tuple[int, ...]

    def idf(self, k: int) -> float:
        n = self.with_phrase[k]
        value = math.log((self.rows - n + 0.5) / (n + 0.5))
        return value if value > 0 else LEAST_IDF


def phrases(terms: str) -> list[list[str]]:
    """Each blank-separated term is one phrase; terms without a token are left out."""
    if not terms.split():
        raise QueryError("empty search terms")
    return [p for t in terms.split() if (p := tokenize(t))]


def count_phrase(found: Column, phrase: list[str]) -> Column:
    """Occurrences of a phrase in a token array."""
    if len(phrase) == 1:
        return F.size(F.filter(found, lambda x: x == phrase[0])).cast("long")

    def here(x: Column, i: Column) -> Column:
        return reduce(lambda a, b: a & b, [x == phrase[0], *[F.coalesce(F.get(found, i + k) == w, F.lit(False)) for k, w in enumerate(phrase[1:], 1)]])

    return F.size(F.filter(found, here)).cast("long")


def scan(docs: DataFrame, columns: list[str], query: list[list[str]], key: str = "relpath") -> DataFrame:
    """(key, n_tokens, f0, f1, ...) of every row, from texts: one narrow pass, no shuffle."""

    def of(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n_tokens"), *[count_phrase(found, p).alias(f"f{k}") for k, p in enumerate(query)])

    # Bound by ``let``, so that the optimizer can't put the tokenizer inside the phrase lambdas.
    per = docs.select(key, *[let(tokens(F.col(c)), of).alias(f"x{i}") for i, c in enumerate(columns)])
    names = ["n_tokens", *[f"f{k}" for k in range(len(query))]]
    return per.select(key, *[reduce(lambda a, b: a + b, [F.col(f"x{i}.{n}") for i in range(len(columns))]).alias(n) for n in names])


def tokenised(docs: DataFrame, columns: list[str], key: str = "relpath") -> DataFrame:
    """(key, n_tokens, t0, t1, ...): each column's tokens, found once for postings and lengths."""
    found = docs.select(key, *[tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    return found.withColumn("n_tokens", reduce(lambda a, b: a + b, [F.size(f"t{i}") for i in range(len(columns))]).cast("long"))


def exploded(found: DataFrame, n_columns: int, key: str = "relpath") -> DataFrame:
    """(key, col, pos, term, n_tokens): one row per token of ``tokenised``."""
    return reduce(DataFrame.unionByName, [found.select(key, F.lit(i).alias("col"), F.posexplode(f"t{i}").alias("pos", "term"), "n_tokens") for i in range(n_columns)])


def _arranged(keys: pa.Array, found: list[tuple[np.ndarray, pa.Array]], key: str) -> pa.Table:
    """Rows of ``grouped`` of some documents, in the order of (term, key), from the number of tokens of each and the tokens, for each column."""
    total = sum(n for n, _ in found)
    doc = np.concatenate([np.repeat(np.arange(len(keys), dtype=np.int32), n) for n, _ in found])
    pos = np.concatenate([(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32) for n, _ in found])
    col = np.repeat(np.arange(len(found), dtype=np.int8), [n.sum() for n, _ in found])
    terms = pa.chunked_array([t for _, t in found]).combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy()

    def place(values) -> np.ndarray:
        out = np.empty(len(values), np.int64)
        out[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
        return out

    group = place(terms.dictionary)[code] * len(keys) + place(keys)[doc]
    # Equal ones stay in the order of columns and positions.
    order = np.argsort(group, kind="stable")
    begins = np.diff(group[order], prepend=-1) != 0
    first, number = np.flatnonzero(begins), np.cumsum(begins) - 1
    at = []
    for i in range(len(found)):
        of = col[order] == i
        ends = np.cumsum(np.bincount(number[of], minlength=len(first)))
        at.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pos[order][of]))
    of = doc[order][first]
    out = [keys.take(pa.array(of)), pa.array(total[of], pa.int64()), terms.dictionary.take(terms.indices.take(pa.array(order[first]))), *at]
    return pa.table(out, [key, "n_tokens", "term", *[f"p{i}" for i in range(len(found))]])


def _in_runs(docs: DataFrame, n_columns: int, key: str, reader, lengths: bool) -> DataFrame:
    """Rows of ``grouped`` from what ``reader()`` finds in a batch; with ``lengths``, first a row without term for each document of a run.

    Documents stay in their tasks, so nothing is shuffled; each task puts its rows in
    the order of (term, key), in runs of ``RUN`` tokens, so its memory is bounded.
    """
    names = [key, "n_tokens", "term", *[f"p{i}" for i in range(n_columns)]]

    def arrange(held):
        keys = pa.chunked_array([k for k, _ in held]).combine_chunks()
        found = [(np.concatenate([f[i][0] for _, f in held]), pa.chunked_array([f[i][1] for _, f in held]).combine_chunks()) for i in range(n_columns)]
        if lengths:
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(keys) + 1, np.int32)), pa.array([], pa.int32()))
            yield from pa.table([keys, pa.array(sum(n for n, _ in found), pa.int64()), pa.nulls(len(keys), pa.string()), *[none] * n_columns], names).to_batches(1 << 16)
        yield from _arranged(keys, found, key).to_batches(1 << 16)

    def run(batches):
        find, held, size = reader(), [], 0
        for batch in batches:
            # In parts of STEP documents, or less if they are large.
            ends = np.arange(batch.num_rows) // STEP + np.cumsum(sum(_weights(batch.column(i)) for i in range(1, batch.num_columns))) // STEP_BYTES
            cuts = [0, *np.flatnonzero(np.diff(ends)) + 1, batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(i, j - i)
                held.append((part.column(0), [find(part.column(k)) for k in range(1, n_columns + 1)]))
                size += len(part) + sum(len(t) for _, t in held[-1][1])
                if size >= RUN:
                    yield from arrange(held)
                    held, size = [], 0
        if held:
            yield from arrange(held)
        pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)[key]
    return docs.mapInArrow(run, f"`{key}` {kind}, n_tokens long, term string, " + ", ".join(f"p{i} array<int>" for i in range(n_columns)))


def _weights(column: pa.Array) -> np.ndarray:
    """Bytes of texts, or tokens of lists."""
    sizes = pc.list_value_length(column) if pa.types.is_nested(column.type) else pc.binary_length(column)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def grouped(found: DataFrame, n_columns: int, key: str = "relpath") -> DataFrame:
    """(key, n_tokens, term, p0, p1, ...): one row per term of a document of ``tokenised``, with its positions in each column."""
    listed = lambda x: (pc.list_value_length(x).to_numpy(), x.flatten())
    return _in_runs(found.select(key, *[f"t{i}" for i in range(n_columns)]), n_columns, key, lambda: listed, False)


def indexed(docs: DataFrame, columns: list[str], key: str = "relpath") -> DataFrame:
    """``grouped`` straight from texts, and a row without term for each document, which has its length: tokens are stored nowhere else."""
    tables = fold_tables()

    def reader():
        codes = code_table(tables)
        return lambda texts: find_tokens(texts, codes)

    return _in_runs(docs.select(key, *columns), len(columns), key, reader, True)


def ungrouped(rows: DataFrame, n_columns: int, key: str = "relpath") -> DataFrame:
    """(key, col, pos, term, n_tokens): one row per token, as ``exploded`` makes them, from rows of ``grouped``."""

    def of(i: int) -> Column:
        return F.transform(f"p{i}", lambda p: F.struct(F.lit(i).alias("col"), p.alias("pos")))

    return rows.select(key, F.explode(F.concat(*map(of, range(n_columns)))).alias("x"), "term", "n_tokens").select(key, "x.col", "x.pos", "term", "n_tokens")


def occurrences(n_columns: int) -> Column:
    """Tokens that a row of ``grouped`` stands for."""
    return reduce(lambda a, b: a + b, [F.size(f"p{i}") for i in range(n_columns)]).cast("long")


def postings(docs: DataFrame, columns: list[str], key: str = "relpath") -> DataFrame:
    """(key, col, pos, term): one row per token."""
    parts = [docs.select(key, F.lit(i).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for i, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, parts)


def lengths(docs: DataFrame, columns: list[str], key: str = "relpath") -> DataFrame:
    """(key, n_tokens) of every row."""
    return docs.select(key, reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in columns]).cast("long").alias("n_tokens"))


def sizes(rows: DataFrame, key: str = "relpath") -> DataFrame:
    """(key, n_tokens) of every document, from rows of ``indexed``."""
    return rows.where("term IS NULL").select(key, "n_tokens")


def term_stats(rows: DataFrame, n_columns: int) -> DataFrame:
    """(term, n_docs, n_total) from rows of ``grouped``, each of which is one document of its term."""
    return rows.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(occurrences(n_columns)).alias("n_total"))


def lookup(post: DataFrame, sizes: DataFrame | None, query: list[list[str]], key: str = "relpath") -> DataFrame:
    """As ``scan``, for matching rows only, from postings clustered by term, which carry lengths unless ``sizes`` does.

    Only the query's terms are read.  Each term's position less its place in the
    phrase is where the phrase would begin; a phrase is there if all its places
    agree on a beginning, so one aggregation replaces a chain of joins.
    """
    wanted = sorted({t for p in query for t in p})
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("place"), F.lit(t).alias("word")) for k, p in enumerate(query) for i, t in enumerate(p)]))
    post = post if sizes is None else post.withColumn("n_tokens", F.lit(0).cast("long"))
    # Dealt by document once, which serves both aggregations.
    hits = post.where(F.col("term").isin(wanted)).repartition(key).select(key, "n_tokens", "col", "pos", "term", places.alias("x")).where("term = x.word")
    begins = hits.groupBy(key, F.col("x.phrase").alias("phrase"), "col", (F.col("pos") - F.col("x.place")).alias("begin")).agg(F.count("*").alias("n"), F.first("n_tokens").alias("n_tokens"))
    size = F.create_map(*[F.lit(v) for k, p in enumerate(query) for v in (k, len(p))])
    full = begins.where(F.col("n") == F.element_at(size, F.col("phrase")))
    counts = full.groupBy(key).agg(F.first("n_tokens").alias("n_tokens"), *[F.count(F.when(F.col("phrase") == k, 1)).alias(f"f{k}") for k in range(len(query))])
    return (counts if sizes is None else counts.drop("n_tokens").join(sizes, key)).select(key, "n_tokens", *[f"f{k}" for k in range(len(query))])


def lookup_rows(rows: DataFrame, n_columns: int, query: list[list[str]], key: str = "relpath") -> DataFrame:
    """As ``lookup``, from rows of ``grouped``: one row a word of a document is dealt, whatever its occurrences.

    Positions are dealt only of words that phrases need; a phrase begins where the
    positions of its words, less their places, meet.
    """
    long = sorted({t for p in query if len(p) > 1 for t in p})
    of = lambda t: F.col("term") == t
    at = F.struct(*[f"p{i}" for i in range(n_columns)])
    hits = rows.where(F.col("term").isin(sorted({t for p in query for t in p}))).select(key, "n_tokens", "term", occurrences(n_columns).alias("n"), *([F.when(F.col("term").isin(long), at).alias("at")] if long else []))
    single = [F.coalesce(F.sum(F.when(of(p[0]), F.col("n"))), F.lit(0)).cast("long").alias(f"f{k}") for k, p in enumerate(query) if len(p) == 1]
    per = hits.groupBy(key).agg(F.first("n_tokens").alias("n_tokens"), *single, *[F.first(F.when(of(t), F.col("at")), ignorenulls=True).alias(f"a{j}") for j, t in enumerate(long)])

    def places(word: str, i: int, place: int) -> Column:
        return F.transform(F.col(f"a{long.index(word)}")[f"p{i}"], lambda x: x - place)

    def begins(phrase: list[str]) -> Column:
        whole = [F.size(reduce(F.array_intersect, [places(t, i, place) for place, t in enumerate(phrase)])) for i in range(n_columns)]
        there = reduce(lambda a, b: a & b, [F.col(f"a{long.index(t)}").isNotNull() for t in phrase])
        return F.when(there, reduce(lambda a, b: a + b, whole)).otherwise(0).cast("long")

    out = per.select(key, "n_tokens", *[(begins(p) if len(p) > 1 else F.col(f"f{k}")).alias(f"f{k}") for k, p in enumerate(query)])
    return out.where(reduce(lambda a, b: a | b, [F.col(f"f{k}") > 0 for k in range(len(query))], F.lit(False)))


def stats(scanned: DataFrame, n_phrases: int) -> Stats:
    r = scanned.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0)), *[F.count(F.when(F.col(f"f{k}") > 0, 1)) for k in range(n_phrases)]).first()
    return Stats(r[0], r[1], tuple(r[2:]))


def bm25(s: Stats, n_phrases: int) -> Column:
    """Negative, so that the best row is the least."""
    mean = s.tokens / s.rows if s.rows else 0.0
    out = F.lit(0.0)
    for k in range(n_phrases):
        f = F.col(f"f{k}").cast("double")
        out = out + F.lit(s.idf(k)) * (f * F.lit(K1 + 1.0)) / (f + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("n_tokens") / F.lit(mean or 1.0)))
    return -out


def matched(scanned: DataFrame, s: Stats, n_phrases: int, key: str = "relpath") -> DataFrame:
    """(key, score) of rows where every phrase occurs; none for a query without tokens."""
    every = reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in range(n_phrases)], F.lit(n_phrases > 0))
    return scanned.where(every).select(key, bm25(s, n_phrases).alias("score"))


def file_filter(area: str | None = None, ext: str | None = None, year: int | None = None, metadata_only: bool = False) -> Column | None:
    """The search filters, None if there is none; what is empty doesn't filter."""
    out = []
    if area:
        out.append(F.col("area") == area)
    if ext:
        out.append(F.col("ext") == ext.lower().lstrip("."))
    if year is not None:
        out.append(F.col("path_year") == year)
    if metadata_only:
        out.append(F.col("metadata_only") == 1)
    return reduce(lambda a, b: a & b, out) if out else None


def ranked(hits: DataFrame, files: DataFrame, keep: Column | None, limit: int | None, key: str = "relpath") -> DataFrame:
    """The best hits whose files pass the filter, by (score, path).

    Filters come after the statistics, so they don't change scores; without one, files aren't read.
    """
    out = (hits if keep is None else hits.join(files.where(keep).select(key), key, "left_semi")).orderBy("score", key)
    return out if limit is None else out.limit(limit)


def check_candidates(*sources: DataFrame, most: int = MAX_CANDIDATES) -> None:
    for s in sources:
        if s.limit(most + 1).count() > most:
            raise QueryError(f"over {most} candidates in one source; narrow the search")


def fuse(names: DataFrame, contents: DataFrame, limit: int, key: str = "relpath") -> DataFrame:
    """Reciprocal-rank fusion: (key, score, matched_by), best first.

    Both inputs are bounded by the candidate limit, so ranking one source in one
    task is bounded too.
    """
    both = names.select(key, "score", F.lit("name").alias("source")).unionByName(contents.select(key, "score", F.lit("content").alias("source")))
    rank = both.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("score", key)))
    share = lambda name: F.max(F.when(F.col("source") == name, 1.0 / (RRF_K + F.col("rank"))))
    per = rank.groupBy(key).agg(share("name").alias("n"), share("content").alias("c"))
    by = F.when(F.col("n").isNotNull() & F.col("c").isNotNull(), "both").when(F.col("n").isNotNull(), "name").otherwise("content")
    return per.select(key, (F.coalesce("n", F.lit(0.0)) + F.coalesce("c", F.lit(0.0))).alias("score"), by.alias("matched_by")).orderBy(F.desc("score"), key).limit(limit)

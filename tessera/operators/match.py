"""Full-text match expressions: a query tree, evaluated as set algebra over postings.

Grammar, loosest first: OR, AND, NOT, then terms side by side, all of which must
match.  A term is a phrase (words or quoted strings joined by ``+``, after ``^`` only
at a column's start, before ``*`` with its last word as a prefix), a group NEAR(a b,
10) or an expression in parentheses; ``column :`` or ``{columns} :``, after ``-`` all
but these, restricts what follows.

All phrases of a query are looked up in one pass over its terms' postings: one
aggregation finds where phrases begin, one more counts them by document, and the tree
is a condition on these counts.  A prefix is a range of the term order, so it is
pruned like a term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .retrieval import QueryError

#: Fixed value: the distance of a NEAR group that names none.
NEAR = 10


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: frozenset[int] | None = None


@dataclass
class Node:
    """``kind`` is and, or, not (the first child without the second), near or phrase."""

    kind: str
    children: list["Node"] = field(default_factory=list)
    phrase: Phrase | None = None
    distance: int = NEAR

    def phrases(self) -> Iterator[Phrase]:
        if self.phrase:
            yield self.phrase
        for c in self.children:
            yield from c.phrases()


_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[\w\x1a\u0080-\U0010ffff]+)|(?P<sign>[(){}:+*^,-]))')


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.at = [c.lower() for c in columns], 0
        self.tokens: list[tuple[str, str]] = []
        i, text = 0, text.rstrip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise QueryError(f"MATCH: syntax error near {text[i:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            i = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        k, v = self.peek()
        if (kind and k != kind) or (value and v != value) or k == "end":
            raise QueryError(f"MATCH: syntax error near {v!r}")
        self.at += 1
        return v

    def is_sign(self, *signs: str) -> bool:
        return self.peek()[0] == "sign" and self.peek()[1] in signs

    def is_operator(self, *names: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in names

    def chain(self, name: str, below) -> Node:
        node = below()
        while self.is_operator(name):
            self.take()
            right = below()
            node = Node(name.lower(), [node, right]) if name == "NOT" or node.kind != name.lower() else Node(node.kind, [*node.children, right])
        return node

    def expression(self) -> Node:
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.side_by_side)))

    def side_by_side(self) -> Node:
        nodes = [self.item()]
        while self.peek()[0] in ("string", "word") and not self.is_operator("OR", "AND", "NOT") or self.is_sign("(", "{", "^", "-"):
            nodes.append(self.item())
        return nodes[0] if len(nodes) == 1 else Node("and", nodes)

    def item(self) -> Node:
        columns = self.column_filter()
        if self.is_sign("("):
            self.take()
            node = self.expression()
            self.take("sign", ")")
        elif self.is_operator("NEAR") and self.peek(1) == ("sign", "("):
            node = self.near()
        else:
            node = self.phrase()
        if columns is not None:
            for p in node.phrases():
                p.columns = columns if p.columns is None else p.columns & columns
        return node

    def column_filter(self) -> frozenset[int] | None:
        negated = self.is_sign("-")
        start = self.at + negated
        kind, value = self.peek(negated)
        names = []
        if (kind, value) == ("sign", "{"):
            self.at = start + 1
            while not self.is_sign("}"):
                names.append(self.take())
            self.take()
        elif kind in ("word", "string") and self.peek(negated + 1) == ("sign", ":"):
            self.at = start + 1
            names.append(value)
        elif negated:
            raise QueryError("MATCH: syntax error near '-'")
        else:
            return None
        self.take("sign", ":")
        names = [n[1:-1].replace('""', '"').lower() if n.startswith('"') else n.lower() for n in names]
        if missing := [n for n in names if n not in self.columns]:
            raise QueryError(f"no such column: {missing[0]}")
        chosen = {self.columns.index(n) for n in names}
        return frozenset(set(range(len(self.columns))) - chosen if negated else chosen)

    def near(self) -> Node:
        self.take()
        self.take("sign", "(")
        parts, distance = [self.phrase()], NEAR
        while not self.is_sign(")", ","):
            parts.append(self.phrase())
        if self.is_sign(","):
            self.take()
            number = self.take("word")
            if not number.isdigit():
                raise QueryError(f"MATCH: expected an integer, got {number!r}")
            distance = int(number)
        self.take("sign", ")")
        return Node("near", parts, distance=distance)

    def phrase(self) -> Node:
        first = self.is_sign("^")
        if first:
            self.take()
        words: list[str] = []
        while True:
            if self.peek()[0] not in ("string", "word") or self.is_operator("OR", "AND", "NOT"):
                raise QueryError(f"MATCH: syntax error near {self.peek()[1]!r}")
            kind, value = self.tokens[self.at]
            self.at += 1
            words += tokenize(value[1:-1].replace('""', '"') if kind == "string" else value)
            if not self.is_sign("+"):
                break
            self.take()
        prefix = self.is_sign("*")
        if prefix:
            self.take()
        return Node("phrase", phrase=Phrase(words, prefix, first))


def parse(text: str, columns: list[str]) -> Node | None:
    """The query tree; None if nothing can match.  Phrases without a word are left out, as if they weren't there."""
    parser = _Parser(text, columns)
    if parser.peek()[0] == "end":
        return None
    node = parser.expression()
    if parser.peek()[0] != "end":
        raise QueryError(f"MATCH: syntax error near {parser.peek()[1]!r}")
    return _without_empty(node)


def _without_empty(node: Node) -> Node | None:
    if node.phrase:
        return node if node.phrase.words else None
    children = [_without_empty(c) for c in node.children]
    if node.kind == "not":
        return children[0] if children[0] is None or children[1] is None else Node("not", children)
    there = [c for c in children if c]
    if len(there) < 2 and node.kind != "near":
        return there[0] if there else None
    return Node(node.kind, there, distance=node.distance) if there else None


def near_places(places: list[list[int]], sizes: list[int], distance: int) -> list[list[int]]:
    """Of the ascending beginnings of each phrase in one column, those that take part in a group.

    A group is a choice of one beginning each, such that none lies more than
    ``distance`` and its phrase's size before the last one.
    """
    at, out, n = [0] * len(places), [[] for _ in places], len(places)
    if not all(places):
        return out
    last = places[0][0]
    while True:
        fits = False
        while not fits:
            fits = True
            for k in range(n):
                least = last - sizes[k] - distance
                if not least <= places[k][at[k]] <= last:
                    fits = False
                    while places[k][at[k]] < least:
                        at[k] += 1
                        if at[k] == len(places[k]):
                            return out
                    last = max(last, places[k][at[k]])
        for k in range(n):
            if not out[k] or out[k][-1] != places[k][at[k]]:
                out[k].append(places[k][at[k]])
        following = [p[i + 1] if i + 1 < len(p) else 1 << 62 for p, i in zip(places, at, strict=True)]
        k = following.index(min(following))
        at[k] += 1
        if at[k] == len(places[k]):
            return out
        last = max(last, places[k][at[k]])


def _with_near(df: DataFrame, groups: list[tuple[list[int], int]], phrases: list[Phrase]) -> DataFrame:
    """f0, ... in place of ``at``, the beginnings of a document's phrases: how many take part in the groups they belong to."""
    n = len(phrases)
    kinds = [(c, t) for c, t in df.dtypes if c != "at"]

    def run(batches):
        for batch in batches:
            found = []
            for places, *own in zip(batch.column("at").to_pylist(), *(batch.column(f"d{k}").to_pylist() for k in range(n)), strict=True):
                for members, distance in groups:
                    total = [0] * len(members)
                    for c in {p["col"] for p in places}:
                        begins = [sorted(p["begin"] for p in places if p["col"] == c and p["phrase"] == k) for k in members]
                        for i, kept in enumerate(near_places(begins, [len(phrases[k].words) for k in members], distance)):
                            total[i] += len(kept)
                    for k, m in zip(members, total, strict=True):
                        own[k] = m
                found.append(own)
            columns = [batch.column(c) for c, _ in kinds] + [pa.array([x[k] for x in found], pa.int64()) for k in range(n)]
            yield pa.RecordBatch.from_arrays(columns, [c for c, _ in kinds] + [f"f{k}" for k in range(n)])

    return df.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in kinds] + [f"f{k} long" for k in range(n)]))


def counts(post: DataFrame, node: Node, key: str = "relpath") -> DataFrame:
    """(key, n_tokens, d0, ..., f0, ...) of documents with any phrase: d the phrases' own counts, f those within the groups they belong to."""
    phrases = list(node.phrases())
    wanted: dict[tuple[str, bool], None] = {}
    for p in phrases:
        for i, w in enumerate(p.words):
            wanted[w, p.prefix and i == len(p.words) - 1] = None
    of_term = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
    exact = [w for w, prefix in wanted if not prefix]
    read = [F.col("term").isin(exact)] * bool(exact) + [of_term(w, True) for w, prefix in wanted if prefix]
    places = F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("place"), of_term(w, p.prefix and i == len(p.words) - 1).alias("here")) for k, p in enumerate(phrases) for i, w in enumerate(p.words)])
    # Dealt by document once, which serves all aggregations.
    hits = post.where(reduce(lambda a, b: a | b, read)).repartition(key).select(key, "n_tokens", "col", "pos", F.explode(F.filter(places, lambda x: x["here"])).alias("x"))
    phrase, begin = F.col("x.phrase"), F.col("pos") - F.col("x.place")
    begins = hits.groupBy(key, phrase.alias("phrase"), "col", begin.alias("begin")).agg(F.countDistinct("x.place").alias("n"), F.first("n_tokens").alias("n_tokens"))
    whole = F.lit(False)
    for k, p in enumerate(phrases):
        one = (F.col("phrase") == k) & (F.col("n") == len(p.words))
        if p.columns is not None:
            one = one & F.col("col").isin(sorted(p.columns))
        whole = whole | (one & (F.col("begin") == 0) if p.first else one)
    full = begins.where(whole)
    groups = list(_near_groups(node))
    per = [F.count(F.when(F.col("phrase") == k, 1)).alias(f"d{k}") for k in range(len(phrases))]
    if not groups:
        out = full.groupBy(key).agg(F.first("n_tokens").alias("n_tokens"), *per)
        return out.select("*", *[F.col(f"d{k}").alias(f"f{k}") for k in range(len(phrases))])
    at = F.collect_list(F.struct("phrase", "col", "begin")).alias("at")
    out = full.groupBy(key).agg(F.first("n_tokens").alias("n_tokens"), *per, at)
    return _with_near(out, groups, phrases)


def _near_groups(node: Node, first: int = 0) -> Iterator[tuple[list[int], int]]:
    """(numbers of the phrases, distance) of each NEAR group."""
    if node.kind == "near":
        yield list(range(first, first + len(node.children))), node.distance
        return
    for c in node.children:
        yield from _near_groups(c, first)
        first += sum(1 for _ in c.phrases())


def condition(node: Node, first: int = 0) -> tuple[Column, int]:
    """(whether a document of ``counts`` matches, the number of the next phrase)."""
    if node.kind == "phrase":
        return F.col(f"f{first}") > 0, first + 1
    parts = []
    for c in node.children:
        one, first = condition(c, first)
        parts.append(one)
    if node.kind == "not":
        return parts[0] & ~parts[1], first
    return reduce((lambda a, b: a | b) if node.kind == "or" else (lambda a, b: a & b), parts), first


def counted(node: Node, first: int = 0, outer: Column | None = None) -> list[Column]:
    """For each phrase, its occurrences that count for the score: those of parts of the tree that match."""
    here = condition(node, first)[0]
    outer = here if outer is None else outer & here
    if node.kind == "phrase":
        return [F.when(outer, F.col(f"f{first}")).otherwise(0)]
    out = []
    for c in node.children:
        if node.kind == "near":
            out.append(F.when(outer, F.col(f"f{first}")).otherwise(0))
        elif node.kind == "not" and c is node.children[1]:
            out += [F.lit(0)] * sum(1 for _ in c.phrases())
        else:
            out += counted(c, first, outer)
        first += sum(1 for _ in c.phrases())
    return out


def places_in(texts: list[str | None], node: Node, words_of) -> list[tuple[int, int, int, int]]:
    """(column, first word, number of words, phrase) of all matches that count in one document, given its columns' words."""
    words = [words_of(t) if t else [] for t in texts]
    phrases = list(node.phrases())
    found: list[dict[int, list[int]]] = []
    for p in phrases:
        by: dict[int, list[int]] = {}
        n = len(p.words)
        for c, ws in enumerate(words):
            if p.columns is not None and c not in p.columns:
                continue
            fits = lambda i: ws[i : i + n - 1] == p.words[:-1] and (ws[i + n - 1].startswith(p.words[-1]) if p.prefix else ws[i + n - 1] == p.words[-1])  # noqa: B023, E731
            by[c] = [i for i in range(len(ws) - n + 1) if (i == 0 or not p.first) and fits(i)]
        found.append(by)
    for members, distance in _near_groups(node):
        kept = {c: near_places([found[k].get(c, []) for k in members], [len(phrases[k].words) for k in members], distance) for c in range(len(words))}
        for i, k in enumerate(members):
            found[k] = {c: kept[c][i] for c in kept}

    def counting(part: Node, first: int) -> tuple[bool, list[int], int]:
        if part.kind == "phrase":
            return any(found[first].values()), [first], first + 1
        results = []
        for c in part.children:
            results.append(counting(c, first))
            first = results[-1][2]
        if part.kind == "not":
            good, chosen = results[0][0] and not results[1][0], results[0][1]
        elif part.kind == "or":
            good, chosen = any(r[0] for r in results), [k for r in results if r[0] for k in r[1]]
        else:
            good, chosen = all(r[0] for r in results), [k for r in results for k in r[1]]
        return good, chosen if good else [], first

    _, chosen, _ = counting(node, 0)
    return sorted((c, i, len(phrases[k].words), k) for k in chosen for c, at in found[k].items() for i in at)

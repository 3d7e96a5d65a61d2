"""Text functions that stay in the JVM, and the few that can't."""

from __future__ import annotations

import bisect
import functools
import sqlite3
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it.
_BLANK = r"[\t-\r\x1c-\x20\x85   -     　]+"
#: Code points that are looked at one by one, and one that stands for all others.
_LOOKED_AT, _REST = [*range(1, 0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE1000)], 0xA0000


@functools.cache
def fold_tables() -> tuple[str, str, list[tuple[int, int]]]:
    """(from, to) for ``translate``: folded characters, then marks that vanish; and the ranges of token characters.

    All are asked of SQLite's ``unicode61 remove_diacritics 2`` tokenizer, one
    code point at a time, so that they are what it does by definition.
    """
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((i, chr(i)) for i in [*_LOOKED_AT, _REST]))
    folded = dict(con.execute("SELECT doc, term FROM v"))
    marks = [i for i in _LOOKED_AT if i not in folded and unicodedata.category(chr(i)).startswith("M")]
    con.execute("DELETE FROM t")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", ((i, f"a{chr(i)}b") for i in marks))
    whole = [chr(i) for (i,) in con.execute("SELECT doc FROM v GROUP BY doc HAVING count(*) = 1")]
    con.close()
    changed = {chr(k): v for k, v in folded.items() if chr(k) != v}
    looked = set(_LOOKED_AT)
    ranges: list[list[int]] = []
    for i in sorted(folded.keys() & looked):
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    if _REST in folded:
        ranges += [[0x34000, 0xDFFFF], [0xE1000, 0x10FFFF]]
    return "".join(changed) + "".join(sorted(whole)), "".join(changed.values()), sorted(tuple(r) for r in ranges)


def _in_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def token_class() -> str:
    """A token as a regular expression, for engines with plain character classes."""
    return f"[{_in_class(fold_tables()[2])}]+"


@functools.cache
def _raw_token() -> str:
    """As ``token_class`` for Java, of what folds to a token: groups of ranges behind a test of their bounds, so that few are tried."""
    source, target, ranges = fold_tables()
    marks = [(ord(c), ord(c)) for c in source[len(target) :]]
    ranges = sorted([*ranges, *marks])
    groups = [ranges[i : i + 20] for i in range(0, len(ranges), 20)]
    wide = "".join(rf"[\x{{{g[0][0]:x}}}-\x{{{g[-1][1]:x}}}&&[{_in_class(g)}]]" for g in groups)
    # ASCII is decided by the first class alone, so blanks and signs don't try all groups
    return rf"[0-9A-Za-z[\x{{80}}-\x{{10ffff}}&&[{wide}]]]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def fold(text: Column) -> Column:
    """Lower case without diacritics; ASCII, which has none, takes the short way."""
    source, target, _ = fold_tables()
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, source, target))


def tokens(text: Column) -> Column:
    """The index tokens of a text, in order; null has none.

    Tokens are found first and folded one by one, so that the slow way is taken
    only by words that are not ASCII.
    """
    text = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    wide = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({_raw_token()})"), 1), fold), lambda x: x != "")
    return F.when(F.length(text) == F.octet_length(text), plain).otherwise(wide)


def code_table(tables: tuple[str, str, list[tuple[int, int]]]) -> np.ndarray:
    """What each code point becomes in a token, by ``fold_tables``: 0 parts tokens, -1 vanishes."""
    source, target, ranges = tables
    out = np.zeros(0x110000, np.int32)
    for a, b in ranges:
        out[a : b + 1] = np.arange(a, b + 1)
    points = np.frombuffer(source.encode("utf-32-le"), "<u4")
    out[points[: len(target)]] = np.frombuffer(target.encode("utf-32-le"), "<u4")
    out[points[len(target) :]] = -1
    return out


def find_tokens(texts: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """As ``tokens`` for a batch of texts: how many each has, and all in order."""
    # Texts are told apart by line ends, which are in no token; bytes that are no UTF-8 part tokens too.
    whole = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    whole = [t.decode("utf-8", "replace") for t in whole]
    code = codes[np.frombuffer("".join(f"{t}\n" for t in whole).encode("utf-32-le"), "<u4")]
    ends = np.cumsum([len(t) + 1 for t in whole])
    if (code < 0).any():
        left = code >= 0
        ends, code = np.cumsum(left)[ends - 1], code[left]
    inside = code > 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    n = np.diff(np.searchsorted(edges[::2], ends), prepend=0)
    chars = code[inside].astype("<u4")
    data = chars.tobytes().decode("utf-32-le").encode()
    at = np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])])
    if len(data) > len(chars):
        at = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))])[at]
    return n, pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def tokenize(text: str) -> list[str]:
    """``tokens`` on the driver, for query terms."""
    return [t for t, _, _ in token_spans(text)]


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) with positions in ``text`` itself."""
    source, target, ranges = fold_tables()
    table = dict(zip(source, target.ljust(len(source), "\0"), strict=True))
    firsts = [a for a, _ in ranges]
    out, word, start, end = [], [], -1, -1
    for i, ch in enumerate(text):
        c = table.get(ch, ch)
        if c == "\0" and ch != "\0":
            if word:
                end = i + 1
            continue
        k = bisect.bisect(firsts, ord(ch)) - 1
        if k >= 0 and ord(ch) <= ranges[k][1]:
            if not word:
                start = i
            word.append(c)
            end = i + 1
        elif word:
            out.append(("".join(word), start, end))
            word = []
    if word:
        out.append(("".join(word), start, end))
    return out


def collapse_blanks(text: Column) -> Column:
    """Runs of (Python's) white space become one space, none at the ends."""
    # A single space, the usual case, stays as it is and isn't matched.  A character is tried
    # once, and what is wider than a byte is behind a test of its bounds.
    narrow, wide = _BLANK[1:-2].split("\u1680")
    one = rf"[{narrow}[\x{{1680}}-\x{{3000}}&&[\x{{1680}}{wide}]]]"
    return F.trim(F.regexp_replace(text, f"{one}(?:(?<! )|(?={one})){one}*", " "))


def nfc(text: Column) -> Column:
    """NFC form; ASCII, which is its own, is taken as it is."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.when(F.length(text) == F.octet_length(text), text).otherwise(normal(text))


# Named character references of HTML that the native extractor reads.
_ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Visible text of simple pages by patterns: no script or style, tags as spaces, blanks collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[!/?a-zA-Z][^>]*>", " ")
    for name, value in _ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(value))
    return collapse_blanks(t)


def tsv_cell(value: Column) -> Column:
    """A string for a TSV cell: control characters as spaces, and no leading formula sign."""
    clean = F.regexp_replace(value, r"[\x00-\x1f\x7f]", " ")
    return F.coalesce(F.when(clean.rlike(r"\A[=+@-]"), F.concat(F.lit("'"), clean)).otherwise(clean), F.lit(""))

"""Snippets: the best window of tokens around phrase matches, for the final hits only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import token_spans

# Fixed values of the format.
N_TOKENS, OPEN, CLOSE, DOTS, MAX_CHARS = 12, "[", "]", " … ", 2048
_NEW_PHRASE, _SEEN_PHRASE, _AT_START, _AT_SENTENCE = 1000, 1, 120, 100


def instances(words: list[str], query: list[list[str]]) -> list[tuple[int, int]]:
    """(token offset, phrase) of all matches in order."""
    return sorted((i, k) for k, p in enumerate(query) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)


def snippet_of(text: str, query: list[list[str]], size: int = N_TOKENS) -> str:
    spans = token_spans(text)
    found = instances([w for w, _, _ in spans], query)
    return windowed(text, spans, found, [len(p) for p in query], size)[:MAX_CHARS]


def windowed(text: str, spans: list, found: list[tuple[int, int]], sizes: list[int], size: int, marks: tuple[str, str, str] = (OPEN, CLOSE, DOTS)) -> str:
    """The best window of ``size`` tokens, with the matches (first token, phrase) in it between marks."""
    total = len(spans)

    def value(begin: int) -> tuple[int, int]:
        """The worth of the window from ``begin``, and where it would be centred."""
        inside = [(o, k) for o, k in found if begin <= o < begin + size]
        worth = _NEW_PHRASE * len({k for _, k in inside}) + _SEEN_PHRASE * (len(inside) - len({k for _, k in inside}))
        if not inside:
            return worth, begin
        first = inside[0][0]
        last = inside[-1][0] + sizes[inside[-1][1]]
        centred = first - int((size - (last - first)) / 2)
        return worth, max(0, min(centred, total - size))

    sentences = [0] + [i for i in range(1, total) if re.search(r"[.:][ \t\n\r]+\Z", text[: spans[i][1]])] if total > size else [0]
    best, start = 0, 0
    for o, _ in found:
        worth, centred = value(o)
        if worth > best:
            best, start = worth, centred
        if total > size:
            head = max((s for s in sentences if s <= o), default=sentences[0])
            if head < o:
                worth = value(head)[0] + (_AT_START if head == 0 else _AT_SENTENCE)
                if worth > best:
                    best, start = worth, head
    return render(text, spans, found, sizes, start, size, marks)


def render(text: str, spans: list, found: list[tuple[int, int]], sizes: list[int], start: int, size: int, marks: tuple[str, str, str]) -> str:
    """The tokens from ``start`` on with what is around them, matches between the first two marks."""
    opening, closing, dots = marks
    total = len(spans)
    end = min(start + size, total)
    if not total:
        return text
    merged: list[list[int]] = []
    for o, k in found:
        a, b = max(o, start), min(o + sizes[k], end)
        if a >= b:
            continue
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [dots] if start > 0 else [], spans[start][1] if start > 0 else 0
    for a, b in merged:
        out += [text[at : spans[a][1]], opening, text[spans[a][1] : spans[b - 1][2]], closing]
        at = spans[b - 1][2]
    if start + size >= total:
        out.append(text[at:])
    else:
        out += [text[at : spans[end - 1][2]], dots]
    return "".join(out)


def snippet(text: Column, query: list[list[str]]) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet_of(t, query))

    return run(text)

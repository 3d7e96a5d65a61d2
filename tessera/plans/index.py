"""A published index: status, search, names and SQL."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_spans
from ..operators import match as M
from ..operators import retrieval as R
from ..operators import snippet as S
from ..schema import HIT_COLUMNS
from . import publish, sqlguard
from .search import INDEXES, PARTS, Tables

#: The full-text tables of the SQL surface, and the indexes behind them.
FULL_TEXT = {"files_fts": "names", "content_fts": "content"}
_STRING = r"'(?:[^']|'')*'"
_OTHER = rf"(?P<other>{_STRING}|\"[^\"]*\"|`[^`]*`|--[^\n]*)"
_MATCH = rf"\b(?:(?P<alias>\w+)\.)?(?P<table>files_fts|content_fts)\s+MATCH\s+(?P<terms>{_STRING})"
_AUXILIARY = rf"\b(?P<function>bm25|snippet|highlight)\s*\(\s*(?P<of>files_fts|content_fts)\s*(?P<rest>(?:,\s*(?:{_STRING}|-?[0-9.]+)\s*)*)\)"
_KEYWORDS = "where|join|on|using|group|order|limit|left|right|inner|full|cross|natural|union|semi|anti|having|match|window|intersect|except"


class Index(Tables):
    """Opens the snapshot in use of a publication folder, or a snapshot itself."""

    def __init__(self, spark: SparkSession, path: str):
        snapshot = path if os.path.exists(f"{path}/meta.json") else publish.current(path)
        if snapshot is None:
            raise publish.PublicationError(f"no index in {path}")
        super().__init__(spark, snapshot)
        self.meta = publish.read_meta(snapshot)
        if missing := [t for t in ("files", "content", *(f"{i}_{k}" for i in INDEXES for k in PARTS)) if not os.path.isdir(f"{snapshot}/{t}")]:
            raise publish.PublicationError(f"the index lacks {', '.join(missing)}")

    def status(self) -> dict:
        return self.meta

    def _rows(self, df: DataFrame) -> list[dict]:
        out = []
        for r in df.collect():
            d = r.asDict()
            d["name_meta"] = json.loads(d["name_meta"]) if d["name_meta"] else None
            out.append({k: d[k] for k in [*HIT_COLUMNS, "matched_by", "score", "snippet"]})
        return out

    def name(self, terms: str, limit: int = 20, **filters) -> list[dict]:
        return self._rows(self.names(terms, limit, **filters))

    def search(self, terms: str, limit: int = 20, **filters) -> list[dict]:
        return self._rows(super().search(terms, limit, **filters))

    def meta_table(self) -> DataFrame:
        """One row; lists and maps as JSON text."""
        row = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v for k, v in self.meta.items()}
        kinds = {int: "long", float: "double", bool: "boolean"}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in row.items()))

    def sql(self, text: str) -> list[dict]:
        """Rows of a bounded statement over ``files``, ``content``, ``meta``, and ``files_fts`` and ``content_fts`` for MATCH."""
        statement = with_full_text(self, text)
        tables = {"files": self.table("files"), "content": self.table("content"), "meta": self.meta_table()} | statement.tables
        return sqlguard.run_sql(self.spark, statement.text, tables, hidden=statement.hidden)


@dataclass
class Statement:
    text: str
    tables: dict[str, DataFrame]
    hidden: dict[str, DataFrame]


def with_full_text(index: Tables, text: str) -> Statement:
    """A statement with its MATCH conditions and their functions put as relations and columns.

    A MATCH alone becomes a condition on the paths it finds.  Where ``bm25``,
    ``snippet`` or ``highlight`` of a table are used, the table is joined with the
    result of each of its MATCH conditions, which carries the score, and the condition
    and the functions become columns.  A function belongs to the next MATCH of its
    table in the statement, or to the last one if none follows.
    """
    tables = {"files_fts": index.table("files").select("relpath", *INDEXES["names"][1]), "content_fts": index.table("content").select("relpath", "text")}
    hidden: dict[str, DataFrame] = {}
    matches: dict[str, list[tuple[int, str]]] = {t: [] for t in tables}
    ranked: set[str] = set()
    for found in re.finditer(f"{_OTHER}|{_MATCH}|{_AUXILIARY}", text, flags=re.I):
        if found["table"]:
            matches[found["table"].lower()].append((found.start(), _unquoted(found["terms"])))
        elif found["function"]:
            ranked.add(found["of"].lower())
    joined = {t: [(k, index.matches(FULL_TEXT[t], terms)) for k, (_, terms) in enumerate(matches[t])] for t in tables if t in ranked}
    for t, found in joined.items():
        if not found:
            raise R.QueryError(f"functions of {t} need a MATCH condition")
        for k, hits in found:
            tables[t] = tables[t].join(hits.select("relpath", F.lit(True).alias(f"match_{k}"), F.col("score").alias(f"bm25_{k}")), "relpath", "left")
    used = dict.fromkeys(tables, 0)

    def one(found: re.Match) -> str:
        if found["other"]:
            return found["other"]
        t = (found["table"] or found["of"]).lower()
        if found["table"]:
            k, used[t] = used[t], used[t] + 1
            alias = found["alias"] or _alias(text, t)
            if t in joined:
                return f"{alias}.match_{k}"
            hidden[f"{t}_match_{k}"] = index.matches(FULL_TEXT[t], matches[t][k][1]).select("relpath")
            return f"{alias}.relpath IN (SELECT relpath FROM {t}_match_{k})"
        k = next((k for k, (at, _) in enumerate(matches[t]) if at > found.start()), len(matches[t]) - 1)
        if found["function"].lower() == "bm25":
            if found["rest"]:
                raise R.QueryError("bm25 takes no weights: all columns count the same")
            return f"{_alias(text, t)}.bm25_{k}"
        name = f"{found['function'].lower()}_{k}_{len(tables[t].columns)}"
        tables[t] = tables[t].withColumn(name, F.when(F.col(f"match_{k}"), _marked(t, matches[t][k][1], found["function"].lower(), found["rest"])))
        return f"{_alias(text, t)}.{name}"

    return Statement(re.sub(f"{_OTHER}|{_MATCH}|{_AUXILIARY}", one, text, flags=re.I), tables, hidden)


def _unquoted(literal: str) -> str:
    return literal[1:-1].replace("''", "'")


def _alias(text: str, table: str) -> str:
    """What the statement calls a table."""
    found = re.search(rf"\b(?:from|join)\s+{table}(?:\s+as)?\s+(?!(?:{_KEYWORDS})\b)([a-z_]\w*)", text, flags=re.I)
    return found[1] if found else table


def _marked(table: str, terms: str, function: str, rest: str) -> Column:
    """``snippet`` or ``highlight`` of a column, by its arguments as written."""
    columns = INDEXES[FULL_TEXT[table]][1]
    node = M.parse(terms, columns)
    given = [_unquoted(a) if a.startswith("'") else a for a in re.findall(rf"{_STRING}|-?[0-9.]+", rest)]
    wanted = 5 if function == "snippet" else 3
    if len(given) != wanted or not re.fullmatch(r"-?\d+", given[0]) or (wanted == 5 and not given[4].isdigit()):
        raise R.QueryError(f"{function} takes a column's number, marks and, for snippet, dots and a size from 1 to 64")
    column, size = int(given[0]), int(given[4]) if wanted == 5 else 0
    if column >= len(columns) or (wanted == 5 and not 1 <= size <= 64) or (column < 0 and wanted == 3):
        raise R.QueryError(f"{function}: no such column or size")

    @F.pandas_udf("string")
    def run(texts: pd.DataFrame) -> pd.Series:
        return pd.Series([marked_text(list(row), node, column, given[1:4], size) for row in texts.itertuples(index=False)], dtype=object)

    return run(F.struct(*columns))


def marked_text(texts: list[str | None], node: M.Node, column: int, marks: list[str], size: int) -> str:
    """A column with marks around what matches in it; with a ``size``, its best window (of the first best column, if none is named)."""
    spans = [token_spans(t or "") for t in texts]
    places = M.places_in(texts, node, lambda t: [w for w, _, _ in token_spans(t)])
    sizes = [len(p.words) for p in node.phrases()]
    if column < 0:
        worth = [(1000 * len({k for c, _, _, k in places if c == i}), -i) for i in range(len(texts))]
        column = -max(worth)[1]
    found = [(i, k) for c, i, _, k in places if c == column]
    text = texts[column] or ""
    if size:
        return S.windowed(text, spans[column], found, sizes, size, tuple(marks))[: S.MAX_CHARS]
    return S.render(text, spans[column], found, sizes, 0, len(spans[column]), (*marks, ""))

"""A bounded, read-only SQL surface over an index.

A statement is judged twice.  The parsed plan may hold nothing but the parts of a
query, plain table names and functions of an allow list.  It is then analysed, not
run, in a session of its own that can't read files by name, and the analysed plan
may have no other leaves than the views made for it and rows written out in the
statement.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math
import re
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Budgets of one statement.
MAX_ROWS, MAX_OUTPUT, MAX_VALUE, MAX_COLUMNS, MAX_QUERY, MAX_SECONDS = 1_000, 4 << 20, 1 << 20, 24, 64 << 10, 5.0
#: Rows that all tasks of a statement may read from files and shuffles together.
MAX_WORK = 20_000_000
_FIRST_WORDS = {"SELECT", "WITH", "EXPLAIN"}
#: Kinds of functions that compute from their arguments alone, and single ones of other kinds.
_GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "datetime_funcs", "date_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "window_funcs"}
_SINGLE = {"typeof", "coalesce", "nullif", "nvl", "nvl2", "ifnull", "iff", "equal_null"}
_TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
#: Plans that a query is parsed to.
_PARSED = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation",
    "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "UnionLoop", "Unpivot", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Values", "WindowExpression", "WithWindowDefinition",
}
#: Leaves of an analysed plan that hold only what the statement says.
_LEAVES = {"CTERelationRef", "LocalRelation", "OneRowRelation", "UnionLoopRef"}


class SqlError(ValueError):
    """A statement that is not allowed, or exceeds a budget."""


def message(e: BaseException) -> str:
    """What went wrong, in one line, without the bridge's own words."""
    text = str(e)
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause.getCause() is not None and cause.getCause() != cause:
            cause = cause.getCause()
        text = cause.getMessage() or cause.toString()
    lines = [x for x in text.splitlines() if x.strip()] or [type(e).__name__]
    return re.sub(r"^\[[A-Z_.]+\]\s*", "", lines[0].strip()).removesuffix(" SQLSTATE: P0001")


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


class _Judge:
    """Judges plans for statements over ``tables``."""

    def __init__(self, spark: SparkSession, tables: set[str]):
        self.state, self.tables = spark._jsparkSession.sessionState(), tables
        self.catalyst = spark._jvm.org.apache.spark.sql.catalyst

    def parsed(self, node, known: set[str] = frozenset()) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "ExplainCommand":
            return self.parsed(node.logicalPlan(), known)
        if kind not in _PARSED:
            raise SqlError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            names = {r._1().lower() for r in _seq(node.cteRelations())}
            for r in _seq(node.cteRelations()):
                self.parsed(r._2(), known | names)
            known = known | names
        elif kind == "UnresolvedRelation":
            name = [str(x).lower() for x in _seq(node.multipartIdentifier())]
            if len(name) != 1 or name[0] not in self.tables | known:
                raise SqlError(f"no such table: {'.'.join(name)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = [str(x).lower() for x in _seq(node.name())]
            if len(name) != 1 or name[0] not in _TABLE_FUNCTIONS:
                raise SqlError(f"the table function {'.'.join(name)} is not allowed")
        for e in _seq(node.expressions()):
            self.expression(e, known)
        for c in _seq(node.children()):
            self.parsed(c, known)

    def expression(self, e, known: set[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            self.function(_seq(e.nameParts()) if kind == "UnresolvedFunction" else [e.name().funcName()])
        elif "Identifier" in kind or "Parameter" in kind or "Variable" in kind and "Lambda" not in kind:
            raise SqlError(f"{kind} is not allowed")
        if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "ArraySubquery", "TableArg", "FunctionTableSubqueryArgumentExpression"):
            self.parsed(e.plan(), known)
        for c in _seq(e.children()):
            self.expression(c, known)

    def function(self, parts: list) -> None:
        name, info = str(parts[-1]).lower(), None
        if len(parts) == 1:
            found = self.state.functionRegistry().lookupFunction(self.catalyst.FunctionIdentifier(name))
            info = found.get() if found.isDefined() else None
        if info is None or info.getSource() != "built-in" or (info.getGroup() not in _GROUPS and name not in _SINGLE):
            raise SqlError(f"the function {'.'.join(map(str, parts))} is not allowed")

    def analysed(self, node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "View":
            # a view of another session can't be named here, so this is one of ours
            if not node.isTempView() or str(node.desc().identifier().table()).lower() not in self.tables:
                raise SqlError("only the tables of the index can be read")
            return
        children = _seq(node.children())
        if not children and kind not in _LEAVES:
            raise SqlError(f"only the tables of the index can be read, not a {kind}")
        for e in _seq(node.subqueries()):
            self.analysed(e)
        for c in children:
            self.analysed(c)


def glob_regex(glob: str) -> str:
    """The Java pattern of a GLOB pattern, which knows ``*``, ``?``, ``[...]`` and ``[^...]``."""
    out, i = [], 0
    while i < len(glob):
        c, end = glob[i], glob.find("]", i + 2 + glob.startswith("[^", i))
        if c == "[" and end > 0:
            negated = glob.startswith("[^", i)
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", glob[i + 1 + negated : end])
            out.append(f"[{'^' * negated}{inside}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or ord(c) > 127 else f"\\{c}"))
        i += 1
    return f"(?s)\\A{''.join(out)}\\z"


def with_globs(text: str) -> str:
    """The statement with RLIKE in place of each GLOB that a literal follows."""

    def one(found: re.Match) -> str:
        if found["other"]:
            return found["other"]
        pattern = glob_regex(found["glob"].replace("''", "'"))
        return "RLIKE '" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return re.sub(r"\bGLOB\s+'(?P<glob>(?:[^']|'')*)'|(?P<other>'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*)", one, text, flags=re.I)


def checked(spark: SparkSession, text: str, tables: dict[str, DataFrame], hidden: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of one allowed statement over these tables, in a session of its own.

    ``hidden`` tables can be read but aren't listed in ``catalog_tables``.
    """
    text = with_globs(text)
    if not text.split() or text.split()[0].upper() not in _FIRST_WORDS:
        raise SqlError("only SELECT, WITH or EXPLAIN is allowed")
    if len(text.encode()) > MAX_QUERY:
        raise SqlError("the statement is too long")
    views = dict(tables)
    views["catalog_tables"] = spark.createDataFrame([(n, "table", f"CREATE TABLE {n} ({', '.join(f'{c} {t}' for c, t in d.dtypes)})") for n, d in tables.items()], "name string, type string, sql string")
    views |= hidden or {}
    # With the settings of the caller's session, whose views it leaves alone.
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    judge = _Judge(own, {n.lower() for n in views})
    try:
        plan = judge.state.sqlParser().parsePlan(text)
        judge.parsed(plan)
        for n, d in views.items():
            spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, d._jdf.queryExecution().analyzed()).createOrReplaceTempView(n)
        skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
        query = plan.logicalPlan() if plan.getClass().getSimpleName() == "ExplainCommand" else plan
        judge.analysed(judge.state.executePlan(query, skip).analyzed())
        out = own.sql(text)
    except (PySparkException, Py4JJavaError) as e:
        raise SqlError(message(e)) from None
    if len(out.columns) > MAX_COLUMNS:
        raise SqlError(f"over {MAX_COLUMNS} columns")
    return out


def json_value(x):
    """A value as JSON has it: non-finite floats and bytes as tagged objects, other types as ISO text."""
    if isinstance(x, float) and not math.isfinite(x):
        return {"$float": "nan" if math.isnan(x) else "infinity" if x > 0 else "-infinity"}
    if isinstance(x, (bytes, bytearray)):
        return {"$blob": base64.b64encode(bytes(x)).decode(), "encoding": "base64"}
    if isinstance(x, dict):
        return {str(k): json_value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_value(v) for v in x] if not hasattr(x, "asDict") else json_value(x.asDict(True))
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return x


def _work(spark: SparkSession, group: str) -> int:
    """Rows that the group's tasks have read so far, from files and shuffles."""
    tracker, store, rows = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            try:
                seen = store.lastStageAttempt(stage)
                rows += seen.inputRecords() + seen.shuffleReadRecords()
            except Py4JJavaError:
                continue  # not begun, or forgotten
    return rows


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], seconds: float = MAX_SECONDS, hidden: dict[str, DataFrame] | None = None, work: int = MAX_WORK) -> list[dict]:
    """Rows of a statement as dicts, within every budget.

    Rows come one by one, and no more are taken once a budget is exceeded.  What its
    tasks have read is looked up while they run.
    """
    df = checked(spark, text, tables, hidden)
    names = df.columns
    if len(set(names)) < len(names):
        names = [n if names.index(n) == k else f"{n}:{names[:k].count(n)}" for k, n in enumerate(names)]
    df = df.toDF(*[f"c{k}" for k in range(len(names))])
    for c, kind in df.dtypes:
        nested = kind.startswith(("array", "map", "struct"))
        if nested or kind in ("string", "binary"):
            size = F.octet_length(F.to_json(F.struct(c)) if nested else F.col(c))
            df = df.withColumn(c, F.when(size > MAX_VALUE, F.raise_error(F.lit("a value exceeds the size budget")).cast(kind)).otherwise(F.col(c)))
    group, got = f"sql-{uuid.uuid4().hex}", []

    def fetch() -> None:
        spark.sparkContext.setJobGroup(group, "bounded SQL", interruptOnCancel=True)
        out, size = [], 2
        try:
            for row in df.limit(MAX_ROWS + 1).toLocalIterator():
                if len(out) == MAX_ROWS:
                    raise SqlError(f"over {MAX_ROWS} rows")
                item = {n: json_value(v) for n, v in zip(names, row, strict=True)}
                size += len(json.dumps(item, ensure_ascii=False, separators=(",", ":")).encode()) + bool(out)
                if size > MAX_OUTPUT:
                    raise SqlError("the output exceeds its size budget")
                out.append(item)
            got.append(out)
        except Exception as e:
            got.append(e if isinstance(e, SqlError) else SqlError(message(e)))

    # The caller waits no longer than the budget; tasks end at the next point where they can be stopped.
    worker, end = threading.Thread(target=fetch, daemon=True), time.monotonic() + seconds
    worker.start()
    while worker.is_alive():
        worker.join(max(0.0, min(0.2, end - time.monotonic())))
        if not worker.is_alive():
            break
        late = time.monotonic() >= end
        if late or _work(spark, group) > work:
            spark.sparkContext.cancelJobGroup(group)
            raise SqlError(f"the statement exceeded the work budget of {f'{seconds} s' if late else f'{work} rows read'}")
    if _work(spark, group) > work:
        raise SqlError(f"the statement exceeded the work budget of {work} rows read")
    if isinstance(got[0], SqlError):
        raise got[0]
    return got[0]

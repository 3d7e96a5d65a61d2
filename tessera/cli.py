"""Command line: status, search, name, sql, init and build."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def tsv_cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, (dict, list)):
        return json.dumps(x, ensure_ascii=False)
    if not isinstance(x, str):
        return str(x)
    clean = _CONTROL.sub(" ", x)
    return f"'{clean}" if clean[:1] in ("=", "+", "-", "@") and clean else clean


def emit(rows, tsv: bool, out=None) -> None:
    """JSON, or a table over the union of the rows' keys as first seen."""
    out = out or sys.stdout
    if not tsv:
        print(json.dumps(rows, ensure_ascii=False, indent=2), file=out)
        return
    rows = rows if isinstance(rows, list) else [rows]
    if not rows:
        return
    keys = list(dict.fromkeys(k for r in rows for k in r))
    print("\t".join(map(tsv_cell, keys)), file=out)
    for r in rows:
        print("\t".join(tsv_cell(r.get(k)) for k in keys), file=out)


def folder(text: str) -> str:
    if not text:
        raise argparse.ArgumentTypeError("must not be empty")
    return text


def limit(text: str) -> int:
    if not text.isascii() or not text.isdigit() or not 1 <= int(text) <= 1000:
        raise argparse.ArgumentTypeError("must be from 1 to 1000")
    return int(text)


def default_index() -> str | None:
    """A publication folder or snapshot around the folder that holds this package: above it, or the folder itself."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return next((f for f in (os.path.dirname(here), here) if any(os.path.isfile(os.path.join(f, n)) for n in ("CURRENT", "meta.json"))), None)


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--db", type=folder, default=argparse.SUPPRESS, help="publication folder or snapshot; by default the one around this package")
    shared.add_argument("--tsv", action="store_true", default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="tessera", parents=[shared], allow_abbrev=False)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("status", parents=[shared], allow_abbrev=False)
    for name in ("search", "name"):
        p = commands.add_parser(name, parents=[shared], allow_abbrev=False)
        p.add_argument("terms")
        p.add_argument("--area")
        p.add_argument("--ext")
        p.add_argument("--year", type=int)
        p.add_argument("--metadata-only", action="store_true")
        p.add_argument("--limit", type=limit, default=20)
    commands.add_parser("sql", parents=[shared], allow_abbrev=False).add_argument("statement")
    for name in ("init", "build"):
        commands.add_parser(name).add_argument("--config", required=True)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: done; 1: a build was refused; 2: a wrong call, query or configuration."""
    import pyspark
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    from .operators.retrieval import QueryError
    from .plans.build import BuildError, build
    from .plans.index import Index
    from .plans.publish import PublicationError
    from .plans.sqlguard import SqlError, message
    from .sources import config
    from .sources.walk import WalkError, corpus_id

    given = sys.argv[1:] if argv is None else argv
    if sum(x == "--db" or x.startswith("--db=") for x in given) > 1:
        parser().error("--db may be given once")
    a = parser().parse_args(given)
    try:
        if int(pyspark.__version__.split(".")[0]) < 4:
            raise QueryError(f"PySpark 4 or later is needed, not {pyspark.__version__}")
        if a.command == "init":
            print(corpus_id(config.load(a.config), create=True))
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("tessera").getOrCreate()
        if a.command == "build":
            print(build(spark, config.load(a.config)))
            return 0
        path = getattr(a, "db", None) or default_index()
        if path is None:
            raise QueryError("no index around this package; --db names one")
        index, tsv = Index(spark, path), getattr(a, "tsv", False)
        if a.command == "status":
            emit(index.status(), tsv)
        elif a.command == "sql":
            emit(index.sql(a.statement), tsv)
        else:
            run = index.search if a.command == "search" else index.name
            emit(run(a.terms, a.limit, area=a.area, ext=a.ext, year=a.year, metadata_only=a.metadata_only), tsv)
        return 0
    except (BuildError, WalkError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except (QueryError, SqlError, PublicationError, config.ConfigError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except (PySparkException, Py4JError) as e:
        # Whatever else Spark finds wrong with an index or a query.
        print(f"error: {message(e)}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

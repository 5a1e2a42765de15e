"""``python -m tidemark``: one command, a script, a page, an import or an interactive prompt."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .session import Session


def run_script(session: Session, path: str, out=sys.stdout) -> int:
    """Run a file of one command a line; ``#`` starts a comment. Stops at the first error and returns its code."""
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            result = session.execute(line)
            print(result, file=out)
            if result.code:
                return result.code
            if line.strip().upper() == "EXIT":
                break
    return 0


def prompt(session: Session, lines=sys.stdin, out=sys.stdout) -> int:
    """Read commands until EXIT or the end; errors are shown and the prompt goes on."""
    for line in lines:
        print(session.execute(line), file=out)
        if line.strip().upper() == "EXIT":
            break
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--data-dir", default="tidemark-data")
    p.add_argument("--table")
    p.add_argument("--exec", "--exec-line", dest="line", action="append", default=[], help="run one command; may be repeated")
    p.add_argument("--run-mdb", help="run a script")
    p.add_argument("--import-dir")
    p.add_argument("--query-balance", type=float)
    p.add_argument("--find-id", type=int)
    p.add_argument("--page", nargs=2, type=int, metavar=("NUMBER", "SIZE"))
    p.add_argument("--order", default="id")
    p.add_argument("--desc", action="store_true")
    p.add_argument("--page-json", action="store_true")
    p.add_argument("--dump-log", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        session = Session(spark, args.data_dir, args.table)
        if args.page and args.page_json:
            print(session.page_json(*args.page, args.order, args.desc), file=out)
            return 0
    except EngineError as error:
        print(f"[{type(error).__name__}] {error}", file=out)
        return error.code
    lines = [f"IMPORTDIR({args.import_dir})"] * bool(args.import_dir) + args.line
    if args.query_balance is not None:
        lines.append(f"QBAL({args.query_balance})")
    if args.find_id is not None:
        lines.append(f"FIND({args.find_id})")
    if args.page:
        lines.append(f"PAGE({args.page[0]}, {args.page[1]}, {args.order}, {'desc' if args.desc else 'asc'})")
    if args.dump_log:
        lines.append("SCAN")
    for line in lines:
        result = session.execute(line)
        print(result, file=out)
        if result.code:
            return result.code
    if args.run_mdb:
        return run_script(session, args.run_mdb, out)
    return 0 if lines else prompt(session, out=out)

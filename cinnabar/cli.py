"""python -m cinnabar check [PATH] | similar CODE [--algorithm NAME] [--in PATH] | patterns [PATH]"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinnabar.exceptions import CinnabarError
from cinnabar.operators import detect
from cinnabar.operators.ignore import Ignore
from cinnabar.plans import analysis
from cinnabar.sources import store


ALGORITHMS = ["simhash", "exact_match"]


def _session() -> SparkSession:
    return SparkSession.builder.appName("cinnabar").getOrCreate()


def report(found: dict[str, DataFrame]) -> str:
    """A check's results as text."""
    s, types = found["summary"].first(), found["types"].orderBy("type").collect()
    said = ["Analysis summary", f"  files: {found['records'].select('file_path').distinct().count()}", f"  records: {s['total']}"]
    said.append(f"  duplicates: {s['duplicates']} ({s['duplication_rate']}), {s['health']}" if s["duplicates"] else "  no duplicates")
    said += ["Types"] + [f"  {t['type']}: {t['count']}" for t in types] if types else []
    return "\n".join([*said, s["recommendation"]])


def check(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    if not store.exists(spark, args.path):
        say(f"there is no {args.path}")
        return 1
    found = analysis.check(spark, args.path, analysis.Config(max_files=args.max_files))
    if found["records"].isEmpty():
        say(f"no Python functions or classes in {args.path}")
        return 1
    say(report(found))
    return 0


def similar(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    if not args.code.strip():
        say("the source is empty")
        return 1
    records = analysis.check(spark, args.path)["records"]
    named = lambda rows: rows.join(records.select("id", "function_name", "file_path"), "id")
    if args.algorithm == "exact_match":
        matches = detect.find_similar(records, args.code).select("id", F.lit(1.0).alias("similarity_score"))
    else:
        matches = detect.similar_by_hash(records, args.code, args.threshold)
    rows = named(matches).orderBy(F.desc("similarity_score"), "file_path", "function_name").limit(args.most).collect()
    say(f"{len(rows)} similar" if rows else "nothing similar")
    for r in rows:
        say(f"  {r['similarity_score']:.3f} {r['function_name']} {r['file_path']}")
    return 0


def patterns(spark: SparkSession | None, args: argparse.Namespace, say: Callable[[str], None]) -> int:
    for pattern, source in Ignore(args.path).listed():
        say(f"  {pattern:30} ({source})")
    return 0


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="cinnabar", description="Duplicates, similar code and clusters of functions")
    commands = made.add_subparsers(dest="command", required=True)
    here = {"nargs": "?", "default": "."}
    one = commands.add_parser("check", help="analyse the Python files below a path")
    one.add_argument("path", **here)
    one.add_argument("--max-files", type=int, default=None)
    two = commands.add_parser("similar", help="find code like a given one")
    two.add_argument("code")
    two.add_argument("--algorithm", choices=ALGORITHMS, default=ALGORITHMS[0])
    two.add_argument("--in", dest="path", default=".")
    two.add_argument("--threshold", type=float, default=0.7)
    two.add_argument("--most", type=int, default=100)
    three = commands.add_parser("patterns", help="list the patterns of paths that are left out")
    three.add_argument("path", **here)
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "patterns":
            return patterns(None, args, say)
        return {"check": check, "similar": similar}[args.command](spark or _session(), args, say)
    except CinnabarError as e:
        say(f"error: {e}")
        return 1


def run() -> None:
    sys.exit(main())

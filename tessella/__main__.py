"""Command line: ``python -m tessella index FOLDER REPO=PATH...``, ``search FOLDER QUERY``, ``stats FOLDER``."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("folder")
    i.add_argument("repos", nargs="+", metavar="REPO=PATH")
    s = sub.add_parser("search")
    s.add_argument("folder")
    s.add_argument("query")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--no-graph", action="store_true")
    t = sub.add_parser("stats")
    t.add_argument("folder")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from tessella.api import Index

    spark = SparkSession.builder.getOrCreate()
    if a.command == "index":
        index = Index.build(spark, a.folder, dict(r.split("=", 1) for r in a.repos))
        print(json.dumps(index.stats()))
    elif a.command == "search":
        index = Index(spark, a.folder)
        names = index.table("symbols").select("symbol_id", "repo_id", "qualname", "path", "line_start")
        hits = index.search({0: a.query}, min(a.k, 100), not a.no_graph).join(names, "symbol_id").orderBy("rank")
        print(json.dumps([r.asDict() for r in hits.collect()]))
    else:
        print(json.dumps(Index(spark, a.folder).stats()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m sievework VERB ...: index, update, search, grep, references, structural, dead-code, stats, overview, explain-path."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sievework.api import Engine
from sievework.functions.render import to_json, to_markdown


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sievework", description=__doc__)
    p.add_argument("verb", choices=["index", "update", "search", "grep", "references", "structural", "dead-code", "stats", "overview", "explain-path"])
    p.add_argument("what", nargs="*", help="tree, query, pattern, symbol or intent")
    p.add_argument("--index", default=".sievework", help="folder of the index")
    p.add_argument("--repo", default="repo")
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("--json", action="store_true")
    p.add_argument("--budget", type=int, default=None, help="bytes of output")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("sievework").getOrCreate()
    e = Engine(spark, a.index)
    limit = a.limit or (5 if a.verb == "search" else 20)
    if a.verb == "index":
        print(e.index(a.what[0], a.repo))
    elif a.verb == "update":
        print(e.update(a.what[0], a.repo))
    elif a.verb == "explain-path":
        print(": ".join(e.explain_path(a.what[0], a.what[1])))
    elif a.verb == "search":
        rows = [r.asDict() for r in e.search(" ".join(a.what), a.repo, limit).collect()]
        print(to_json(rows, a.budget) if a.json else to_markdown(rows, a.budget))
    elif a.verb == "overview":
        for name, df in e.overview().items():
            print(f"# {name}")
            df.show(20, False)
    else:
        df = {
            "grep": lambda: e.grep(a.what[0], limit=limit), "references": lambda: e.references(a.what[0], limit), "structural": lambda: e.structural(a.what[0], *a.what[1:2], limit=limit),
            "dead-code": lambda: e.dead_code(limit), "stats": e.stats,
        }[a.verb]()
        df.show(limit, False)


if __name__ == "__main__":
    main()

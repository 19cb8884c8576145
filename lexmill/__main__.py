"""Command line: build, status, skipped, clean, feed, watch, search and serve."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from lexmill.config import config_for, repo_id, worktree_root
from lexmill.operators.index import Index
from lexmill.service import Service, search, serve
from lexmill.sinks.output import status_lines
from lexmill.sources.listing import scan, scanned, skip_report
from lexmill.streaming.changes import stop_when_idle, watch, write_feed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexmill")
    top.add_argument("--root", default=".")
    top.add_argument("--index")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("build")
    commands.add_parser("status").add_argument("--text", action="store_true")
    commands.add_parser("skipped")
    commands.add_parser("clean")
    commands.add_parser("feed").add_argument("feed")
    commands.add_parser("serve")
    w = commands.add_parser("watch")
    w.add_argument("feed")
    s = commands.add_parser("search")
    s.add_argument("pattern")
    s.add_argument("-e", "--regex", action="store_true")
    s.add_argument("-i", "--ignore-case", action="store_true")
    s.add_argument("-U", "--multiline", action="store_true")
    s.add_argument("-n", "--limit", type=int, default=20)
    s.add_argument("-g", "--glob")
    s.add_argument("-c", "--count", action="store_true")
    s.add_argument("-l", "--files-only", action="store_true")
    s.add_argument("-A", "--after", type=int)
    s.add_argument("-B", "--before", type=int)
    s.add_argument("-C", "--context", type=int)
    s.add_argument("--no-snippets", action="store_true")
    s.add_argument("--symbol-regex")
    s.add_argument("--format", dest="style", choices=("default", "plain", "json"), default="default")
    return top


#: How long a feed is idle before an index of many segments is compacted.
COMPACT_AFTER_SECS = 30.0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = vars(parser().parse_args(argv))
    root, command = worktree_root(args.pop("root")), args.pop("command")
    config = config_for(root)
    spark = spark or SparkSession.builder.appName("lexmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    index = Index(spark, args.pop("index") or os.path.join(root, ".lexmill/index"))
    service = Service(index, config)
    if command == "build":
        index.build(scan(spark, root, config), config)
        print(json.dumps(index.status()))
    elif command == "status":
        found = index.status() | {"repo": repo_id(root)}
        print(*status_lines(found), sep="\n") if args["text"] else print(json.dumps(found))
    elif command == "skipped":
        for r in skip_report(scanned(spark, root, config)).orderBy("reason").collect():
            print(f"{r['reason']}: {r['n']}", *r["samples"], sep="\n  ")
    elif command == "clean":
        print(json.dumps({"recovered": index.recover(), "removed": index.generations.clean()}))
    elif command == "feed":
        print(write_feed(index, root, args["feed"], config))
    elif command == "serve":
        serve(service, sys.stdin, sys.stdout)
    elif command == "watch":
        stop_when_idle(watch(spark, args["feed"], index, f"{index.root}/checkpoint", config), config.idle_timeout_secs, index=index, compact_after=COMPACT_AFTER_SECS)
    else:
        return search(service, **args)
    return 0


if __name__ == "__main__":
    sys.exit(main())

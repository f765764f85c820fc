"""python -m tidemark PATH put KEY VALUE | delete KEY | get KEY | scan START END: one operation on a
versioned table with string keys (row Z5).  A key that is not found ends with status 1."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.table import VersionedTable


def run(spark: SparkSession, args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("path")
    what = p.add_subparsers(dest="what", required=True)
    for name, words in {"put": ("key", "value"), "delete": ("key",), "get": ("key",), "scan": ("start", "end")}.items():
        sub = what.add_parser(name)
        for w in words:
            sub.add_argument(w)
        if name in ("get", "scan"):
            sub.add_argument("--at", type=int, help="timestamp of the snapshot")
    a = p.parse_args(args)
    table = VersionedTable(spark, a.path, key="string")
    if a.what == "put":
        print(table.put(a.key, a.value))
    elif a.what == "delete":
        print(table.delete(a.key))
    elif a.what == "get":
        found, value = table.get(a.key, a.at)
        print(value if found else "not found", file=sys.stdout if found else sys.stderr)
        return 0 if found else 1
    else:
        for row in table.scan(a.start, a.end, a.at).toLocalIterator():
            print(row["k"], row["value"], sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("tidemark").getOrCreate(), sys.argv[1:]))

"""Command line: init, index, status, search and clean for one project."""

from __future__ import annotations

import argparse
import json
import os
import time
from dataclasses import fields

from codeloom import config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("command", choices=("init", "index", "status", "search", "clean"))
    p.add_argument("query", nargs="?")
    p.add_argument("--project", default="codeloom.json")
    p.add_argument("--mode", default="auto")
    p.add_argument("--limit", type=int, default=10)
    a = p.parse_args(argv)
    if a.command == "init":
        name = os.path.basename(os.getcwd())
        with open(a.project, "x", encoding="utf-8") as f:
            json.dump({"name": name, "folder": os.getcwd(), "store": os.path.join(os.getcwd(), ".codeloom"), "include": ["*"], "exclude": []}, f, indent=2)
        return 0
    from pyspark.sql import SparkSession

    from codeloom.plans import indexing

    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    known = {f.name for f in fields(indexing.Project)}
    project = indexing.Project(**{k: v for k, v in config.load(a.project).items() if k in known})
    if a.command == "index":
        print(json.dumps(indexing.delta_scan(spark, project, time.time())))
    elif a.command == "status":
        indexing.status(spark, project, time.time()).show(truncate=False, vertical=True)
    elif a.command == "search":
        indexing.search_code(spark, project, a.query or "", a.mode, a.limit).show(truncate=80)
    else:
        for kind in ("code", "relations", "embeddings"):
            project.collection(spark, kind).drop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

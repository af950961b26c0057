"""Command line: python -m cairnlake STORE COMMAND ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .memory import Memory


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnlake")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("status", "sweep", "conflicts", "consolidate", "topics", "purge"):
        sub.add_parser(name)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--scope")
    s.add_argument("--limit", type=int, default=5)
    s = sub.add_parser("learn")
    s.add_argument("content")
    s.add_argument("--scope")
    s = sub.add_parser("list")
    s.add_argument("--scope")
    s.add_argument("--type")
    s.add_argument("--limit", type=int, default=50)
    s = sub.add_parser("forget")
    s.add_argument("id")
    for name in ("export", "import"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--format", default="json", choices=("json", "markdown"))
        s.add_argument("--scope")
    return p


def main(args=None, spark: SparkSession | None = None):
    """Runs a command and returns the DataFrame that it printed, or None."""
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("cairnlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    m = Memory(spark, os.path.abspath(a.store) if "://" not in a.store else a.store)
    match a.command:
        case "status":
            out = m.status()
        case "search":
            out = m.search(a.query, scope=a.scope, limit=a.limit).select("bullet_id", F.round("final_score", 4).alias("score"), "content")
        case "learn":
            out = m.add_records(spark.createDataFrame([(a.content, a.scope or "global")], "content string, scope string"))
        case "list":
            out = m.list(a.scope, a.type, a.limit).select("bullet_id", "section", "knowledge_type", "content")
        case "forget":
            out = m.delete(a.id)
        case "sweep":
            out = m.run_decay_sweep()
        case "conflicts":
            out = m.conflicts_triaged()
        case "consolidate":
            out = m.consolidate_run().groupBy("role").count()
        case "topics":
            out = m.topics()
        case "purge":
            out = m.purge_soft_deleted()
        case "export":
            out = m.export(a.path, a.format, a.scope)
        case _:
            out = m.import_data(a.path)
    if out is not None:
        out.show(truncate=80)
    return out


if __name__ == "__main__":
    main()

"""``python -m lorekeep FOLDER ingest|search|write|status|traces``: a knowledge base from the command line; prints JSON lines."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans.knowledge import KnowledgeBase
from lorekeep.schema import KINDS


def options() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    out.add_argument("folder")
    do = out.add_subparsers(dest="do", required=True)
    for name in ("init", "ingest", "compact"):
        do.add_parser(name)
    search = do.add_parser("search")
    search.add_argument("query")
    for name, kind in (("--limit", int), ("--max-tokens", int), ("--min-score", float)):
        search.add_argument(name, type=kind)
    search.add_argument("--kind", choices=KINDS)
    write = do.add_parser("write")
    write.add_argument("content")
    write.add_argument("--kind", choices=KINDS, default="learning")
    for name in ("--tag", "--supersedes"):
        write.add_argument(name, action="append", default=[])
    do.add_parser("status")
    traces = do.add_parser("traces")
    traces.add_argument("--limit", type=int, default=10)
    traces.add_argument("--name", help="of a span: its beginning")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    kb = KnowledgeBase(spark, args.folder)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  a few at most
    if args.do == "search":
        found, quality = kb.search(args.query, args.limit, args.max_tokens, args.min_score, args.kind)
        return rows(found) + rows(quality)
    if args.do == "write":
        return [kb.write(args.content, args.kind, args.tag, args.supersedes)]
    if args.do == "traces":
        return rows(kb.traces(args.limit, args.name))
    if args.do in ("init", "compact"):
        kb.init() if args.do == "init" else kb.compact()
        return [{"version": kb.index.snapshot().version}]
    done = kb.ingest() if args.do == "ingest" else kb.status()
    return rows(done) if isinstance(done, DataFrame) else [done]


def main(argv: list[str] | None = None) -> None:
    args = options().parse_args(argv)
    spark = SparkSession.builder.appName("lorekeep").getOrCreate()
    for row in run(spark, args):
        print(json.dumps(row, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()

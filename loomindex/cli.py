"""Commands over an index folder: index, watch, query, lookup, show, graph, status, report. Answers are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomindex.operators import changes, results
from loomindex.plans import search as plans
from loomindex.plans.index import read, refresh, refresh_vectors, source_texts
from loomindex.plans.spec import QuerySpec
from loomindex.sources import connectors, tables
from loomindex.streaming.watch import INTERVAL_MS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomindex")
    p.add_argument("--index", required=True, help="folder with the index tables")
    p.add_argument("--versions", action="store_true", help="the folder was written by the index command")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "lookup"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("--limit", "--top", type=int, default=5)
        c.add_argument("--kind", action="append", default=[])
        only = c.add_mutually_exclusive_group()
        only.add_argument("--code-only", action="store_true")
        only.add_argument("--docs-only", action="store_true")
        c.add_argument("--path", action="append", default=[])
        c.add_argument("--exclude-path", action="append", default=[])
        c.add_argument("--exclude-tests", action="store_true")
        c.add_argument("--prefer-implementation", action="store_true")
        c.add_argument("--service", help="embedding service, to search by vectors too")
        c.add_argument("--model", default="")
        if name == "query":
            shape = c.add_mutually_exclusive_group()
            shape.add_argument("--compact", action="store_true", help="only what tells results apart")
            shape.add_argument("--groups", action="store_true", help="results by file")
    for name in ("show", "graph"):
        c = sub.add_parser(name)
        c.add_argument("symbol", help="id or name")
        c.add_argument("--full", action="store_true")
        c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("status")
    c.add_argument("--root", help="compare the index with this source tree")
    c.add_argument("--scope", default="", help="paths to leave out, one a line")
    c = sub.add_parser("report")
    c.add_argument("--flow", nargs="+", default=["view", "click", "purchase"], help="event types that form chains, where the events are not commands")
    c = sub.add_parser("index", help="bring the index tables up to date with a source tree")
    c.add_argument("root")
    c.add_argument("--scope", default="", help="paths to leave out, one a line")
    c.add_argument("--rebuild", action="store_true")
    c.add_argument("--service", help="embedding service for the vectors of symbols")
    c.add_argument("--model", default="")
    c = sub.add_parser("watch", help="do so again and again")
    c.add_argument("root")
    c.add_argument("--scope", default="", help="paths to leave out, one a line")
    c.add_argument("--once", action="store_true")
    c.add_argument("--interval-ms", type=int, default=INTERVAL_MS)
    return p


def answer(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    own = read(spark, args.index) if args.versions else None
    s, f = (own["symbols"], own["files"]) if own else (tables.symbols(spark, args.index), tables.files(spark, args.index))
    if args.command == "status":
        r = own["relations"] if own else tables.relations(spark, args.index)
        diff = changes.file_diff(source_texts(spark, args.root, args.scope).drop("text"), f) if args.root else None
        languages = plans.status(s, f).select(F.lit("language").alias("section"), F.col("language").alias("name"), F.to_json(F.struct("files", "symbols", "parsed", "recovered", "fallback")).alias("value"))
        return languages.unionByName(plans.overview(s, r, f, diff=diff))
    if args.command == "report":
        events = tables.table(spark, args.index, "events")
        # A log of commands gives the whole report, other events how they follow each other.
        return changes.command_report(events) if "command" in events.columns else changes.transitions(events, args.flow)
    r = own["relations"] if own else tables.relations(spark, args.index)
    if args.command in ("query", "lookup"):
        spec = QuerySpec(
            args.text, args.limit, tuple(args.kind), args.docs_only, args.code_only, args.exclude_tests, args.prefer_implementation, tuple(args.path), tuple(args.exclude_path)
        )
        vectors = None
        if args.service:
            asked = connectors.embed_texts(spark.createDataFrame([(0, args.text)], "id bigint, text string"), args.service, args.model).first()
            spec = replace(spec, vector=tuple(asked.embedding), model=args.model, provider=args.service)
            vectors = own["embeddings"] if own else tables.embeddings(spark, args.index)
        if args.command == "lookup":
            return plans.lookup(s, r, f, spec, vectors)
        found = plans.query(s, r, f, spec, vectors)
        if args.groups:
            return results.file_groups(found, "turn").orderBy("first_position")
        return (found.select("turn", "id", "path", "kind", "name", "start_line", "confidence", "score") if args.compact else found).orderBy("turn")
    ids = [int(args.symbol)] if args.symbol.isdigit() else [row.id for row in plans.best_by_name(s, args.symbol).select("id").collect()]
    return plans.show(s, ids, args.full) if args.command == "show" else plans.graph_around(s, r, ids, args.limit)


def watch_tree(spark: SparkSession, args: argparse.Namespace) -> int:
    """Refreshes the index at each interval, until it is stopped; tells what changed."""
    if args.interval_ms < 1:
        raise ValueError("the interval must be positive")
    while True:
        found = refresh(spark, args.root, args.index, args.scope)
        if found or args.once:
            print(json.dumps(found), flush=True)
        if args.once:
            return 0
        time.sleep(args.interval_ms / 1000)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomindex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "index":
        counts = refresh(spark, args.root, args.index, args.scope, args.rebuild)
        print(json.dumps(counts | {"vectors": refresh_vectors(spark, args.index, args.service, args.model)} if args.service else counts))
        return 0
    if args.command == "watch":
        return watch_tree(spark, args)
    for line in answer(spark, args).select(F.to_json(F.struct("*"))).toLocalIterator():
        print(line[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())

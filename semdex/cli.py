"""Command line: index, query (also without the word), reindex, stats, similar, config, mcp."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
from pathlib import Path

from semdex import SCHEMA_VERSION, __version__
from semdex.config import load_for_index
from semdex.functions.dates import parse_date
from semdex.render import FORMATS, render, similar_text, stats_text

COMMANDS = ("index", "query", "reindex", "stats", "similar", "config", "mcp")


def similarity(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"'{text}' is not a number between 0.0 and 1.0") from None
    if not 0.0 <= value <= 1.0:
        raise argparse.ArgumentTypeError(f"'{text}' is out of range; must be between 0.0 and 1.0")
    return value


def date(text: str):
    try:
        return parse_date(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from None


def parser() -> argparse.ArgumentParser:
    flags = argparse.ArgumentParser(add_help=False)
    flags.add_argument("--limit", type=int)
    flags.add_argument("--format", "-f", choices=FORMATS, default="context")
    either = flags.add_mutually_exclusive_group()
    either.add_argument("--rerank", dest="rerank", action="store_const", const=True)
    either.add_argument("--no-rerank", dest="rerank", action="store_const", const=False)
    flags.add_argument("--min-similarity", "-m", type=similarity)
    flags.add_argument("--path")
    flags.add_argument("--after", type=date)
    flags.add_argument("--before", type=date)
    flags.add_argument("--no-auto-index", action="store_true")
    top = argparse.ArgumentParser(prog="semdex")
    top.add_argument("--version", action="version", version=f"semdex {__version__} (schema v{SCHEMA_VERSION})")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("target", metavar="PATH")
    index.add_argument("--debug", action="store_true")
    commands.add_parser("query", parents=[flags]).add_argument("text", nargs="+")
    for name in ("reindex", "stats", "config"):
        commands.add_parser(name)
    commands.add_parser("similar").add_argument("file")
    mcp = commands.add_parser("mcp")
    mcp.add_argument("--transport", choices=("stdio", "http"), default="stdio")
    mcp.add_argument("--index", action="append", default=[])
    mcp.add_argument("--bind")
    return top


def parse(argv: list[str]) -> argparse.Namespace:
    """Words that are no command are a query."""
    first = next((a for a in argv if not a.startswith("-")), None)
    implicit = first is not None and first not in COMMANDS
    args = parser().parse_args(["query", *argv] if implicit else argv)
    if args.command == "mcp" and args.bind and args.transport == "stdio":
        parser().error("--bind needs --transport http")
    return args


def main(argv: list[str] | None = None, spark=None, embedder=None, out=None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    out = out or sys.stdout
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from semdex.operators.search import SearchOptions
    from semdex.plans.indexer import Indexer
    from semdex.plans.searcher import Searcher
    from semdex.sources.crawl import find_index_root

    def root() -> Path:
        found = find_index_root(Path.cwd())
        if found is None:
            raise SystemExit("No index found in directory tree")
        return found

    if args.command == "index":
        n = Indexer(spark, Path(args.target).resolve(), embedder=embedder).refresh()
        print(f"Indexed {n} files.", file=out)
    elif args.command == "reindex":
        print(f"Indexed {Indexer(spark, root(), embedder=embedder).rebuild()} files.", file=out)
    elif args.command == "query":
        searcher = Searcher(spark, root(), embedder=embedder)
        warnings: list[str] = []
        if searcher.config.query.auto_index and not args.no_auto_index:
            refreshed, warnings = searcher.auto_index()
            if refreshed:
                print(f"Refreshed {refreshed} files.", file=sys.stderr)
        text = " ".join(args.text)
        outcome = searcher.search(text, SearchOptions(args.limit, args.rerank, args.path, args.after, args.before, args.min_similarity))
        for w in warnings + outcome.warnings:
            print(f"warning: {w}", file=sys.stderr)
        print(render(args.format, text, str(searcher.store.dir), outcome.results.collect(), outcome.score_kind, outcome.warnings), file=out)
    elif args.command == "stats":
        print(stats_text(Indexer(spark, root(), embedder=embedder).stats()), file=out)
    elif args.command == "similar":
        print(similar_text(Searcher(spark, root(), embedder=embedder).similar(args.file).collect()), file=out)
    elif args.command == "config":
        found = find_index_root(Path.cwd())
        print(json.dumps(dataclasses.asdict(load_for_index(found or Path.cwd())), indent=2), file=out)
    else:
        from semdex import rpc
        from semdex.service import Registry, Service

        registry = Registry.from_flags(args.index) if args.index else Registry.discover(Path.cwd())
        service = Service(spark, registry, (lambda _: embedder) if embedder else None)
        if args.transport == "stdio":
            rpc.serve_stdio(service)
        else:
            rpc.http_server(service, args.bind or rpc.DEFAULT_BIND).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())

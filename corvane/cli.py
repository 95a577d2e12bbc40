"""Command line over the library (SV1): index, reindex, search, query, status and health of one store.

    python -m corvane.cli index NOTES --store STORE
    python -m corvane.cli search "ranking" --store STORE
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from corvane.operators import graph, incremental, metadata
from corvane.plans import indexing, search
from corvane.session import session
from corvane.sources.snapshots import Snapshots


def health(store: Snapshots) -> dict:
    """Rows of each table, and edges whose ends are missing (there should be none)."""
    rows = {r["part"]: r["n"] for r in incremental.health(**{t: store.read(t) for t in store.tables()}).collect()}
    return {"version": store.version, "rows": rows, "consistent": incremental.consistency(store.read("chunks")).first()["consistent"], "dangling_edges": graph.integrity(store.read("nodes"), store.read("edges")).count()}


def run(spark: SparkSession, args: argparse.Namespace) -> list[dict] | dict:
    """The command's result as plain values."""
    store = Snapshots(spark, args.store)
    if args.command in ("index", "reindex"):
        return indexing.index_folder(spark, args.folder, store, args.source, args.chunker, force=args.command == "reindex")
    if args.command == "search":
        found = search.unified(search.Stores.of(store), args.query, args.limit, args.threshold).orderBy("rank")
        return [r.asDict(recursive=True) for r in found.collect()]
    if args.command == "query":
        held = search.Stores.of(store)
        if args.recent:
            return [r.asDict() for r in metadata.latest(held.documents, args.limit).collect()]
        return [r.asDict() for r in search.query_documents(held, any_tag=args.tag, category=args.category, status=args.status, project=args.project, created_after=args.after, created_before=args.before, limit=args.limit).collect()]
    if args.command == "status":
        return {"version": store.version, "tables": store.tables()}
    return health(store)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("index", "reindex", "search", "query", "status", "health"):
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        if name in ("index", "reindex"):
            c.add_argument("folder")
            c.add_argument("--source", default="")
            c.add_argument("--chunker", choices=("hybrid", "semantic", "headers"), default="hybrid")
        if name == "search":
            c.add_argument("query")
            c.add_argument("--threshold", type=float, default=0.3)
        if name in ("search", "query"):
            c.add_argument("--limit", type=int, default=5)
        if name == "query":
            c.add_argument("--tag", action="append")
            for name in ("category", "status", "project", "after", "before"):
                c.add_argument(f"--{name}")
            c.add_argument("--recent", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    print(json.dumps(run(session("corvane-cli"), args), default=str, indent=1))


if __name__ == "__main__":
    main()

"""Command line: `ingest` and `query`. Exit codes: 0 results, 1 none, 2 usage or dimension error, 3 timeout."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from pathlib import Path

from . import session
from .api import Knowledge
from .plans.ingest import Options, ingest
from .plans.routing import resolve_collection
from .sources.readers import git_changes
from .sources.store import Busy, ChunkStore, DimensionMismatch


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kvarn")
    top.add_argument("--db-path", default="vectordb")
    sub = top.add_subparsers(dest="command", required=True)
    put = sub.add_parser("ingest")
    put.add_argument("source")
    put.add_argument("--mode", default="code")
    put.add_argument("--domain", default="general")
    put.add_argument("--collection")
    put.add_argument("--force", action="store_true")
    put.add_argument("--dry-run", action="store_true")
    put.add_argument("--clean-stale", action="store_true")
    put.add_argument("--incremental", action="store_true", help="only what git says has changed since the last clean run")
    put.add_argument("--no-gitignore", action="store_true")
    put.add_argument("--ticket-filter", default="")
    put.add_argument("--include-deprecated", action="store_true")
    put.add_argument("--recreate", action="store_true", help="drop a collection whose vectors have another length")
    put.add_argument("--model")
    put.add_argument("--concepts", help="JSON file with a concept registry")
    put.add_argument("--batch-size", type=int, default=16)
    put.add_argument("--concurrency", type=int, default=4, help="batches that each task has in flight at the embedder")
    put.add_argument("--retry-wait", type=float, default=5.0)
    put.add_argument("--exclusive", action="store_true", help="refuse to start while another run holds the collection")
    put.add_argument("--legacy-checkpoint", help="JSON file with {source: md5} of an older store, taken over once")
    put.add_argument("--vacuum", action="store_true", help="delete what older versions held")
    ask = sub.add_parser("query")
    ask.add_argument("text", nargs="?", default="")
    ask.add_argument("--mode", choices=["semantic", "concept", "codebase", "status"], default="semantic")
    ask.add_argument("--domain", default="general")
    ask.add_argument("--type", default="auto")
    ask.add_argument("--repository")
    ask.add_argument("--dependents", action="store_true")
    ask.add_argument("-k", default=5)
    ask.add_argument("--format", choices=["markdown", "json", "plain"], default="markdown")
    ask.add_argument("--json", action="store_const", const="json", dest="format")
    ask.add_argument("--output", help="write the answer to this file")
    ask.add_argument("--timeout", type=float, default=120.0)
    return top


def put_in(args: argparse.Namespace, spark) -> int:
    registry = json.loads(Path(args.concepts).read_text(encoding="utf-8")) if args.concepts else None
    options = Options(
        mode=args.mode, domain=args.domain, collection=args.collection, model=args.model, registry=registry, batch=args.batch_size, concurrency=args.concurrency,
        force=args.force, dry_run=args.dry_run, clean_stale=args.clean_stale, retry_wait=args.retry_wait, gitignore=not args.no_gitignore,
        ticket_filter=args.ticket_filter, keep_deprecated=args.include_deprecated, recreate=args.recreate, exclusive=args.exclusive,
    )
    store = ChunkStore(spark, args.db_path)
    name = resolve_collection(options.mode, options.domain, options.collection)
    if args.legacy_checkpoint:
        store.migrate_checkpoint(json.loads(Path(args.legacy_checkpoint).read_text(encoding="utf-8")), name)
    changes, head = git_changes(spark, args.source, store.git_head(name)) if args.incremental else (None, None)
    try:
        print(json.dumps(ingest(spark, args.db_path, args.source, options, changes, head)))
    except (DimensionMismatch, Busy) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    if args.vacuum:
        store.vacuum()
    return 0


def answer(args: argparse.Namespace, spark) -> str | None:
    """What a query prints, or None where nothing was found."""
    store = Knowledge(spark, args.db_path)
    if args.mode == "status":
        parts = ["\n".join([name, *rows.toJSON().toLocalIterator()]) for name, rows in store.get_db_stats().items()]
        return "\n".join(parts)
    if args.mode == "concept":
        hits = store.search_concepts(args.text)
    else:
        kind = "code" if args.mode == "codebase" else args.type
        hits = store.search_knowledge(args.text, args.domain, kind, args.k, args.repository, args.dependents)
    rows = hits.collect()  # a few times k rows
    if not rows:
        return None
    if args.format == "json":
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in rows)
    return store.plain(hits) if args.format == "plain" else store.markdown(hits)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session.build()
    if args.command == "ingest":
        return put_in(args, spark)
    spark.sparkContext.setJobGroup("query", args.text, interruptOnCancel=True)
    stop = threading.Timer(args.timeout, spark.sparkContext.cancelAllJobs)
    stop.start()
    began = time.monotonic()
    try:
        shown = answer(args, spark)
    except Exception:
        if time.monotonic() - began >= args.timeout:
            print(f"no answer within {args.timeout:g} s", file=sys.stderr)
            return 3
        raise
    finally:
        stop.cancel()
    if shown is None:
        return 1
    if args.output:
        Path(args.output).write_text(shown + "\n", encoding="utf-8")
    else:
        print(shown)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Ingestion: sources → pieces → enriched chunks → vectors → store, as one lazy plan and a few commits."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..embed import Embedder, embed_chunks, hashed_words, split_failed
from ..functions import metadata as M
from ..functions.text import chunk_id, concept_parts
from ..operators.chunkers import chunk, within_limit
from ..sources.readers import changed, csv_rows, discover_ignores, scan
from ..sources.store import ChunkStore
from .routing import detect_model, resolve_collection
from ..functions.tables import SOURCE_TYPE_BY_MODE


@dataclass
class Options:
    mode: str = "code"
    domain: str = "general"
    collection: str | None = None
    model: str | None = None
    registry: dict | None = None
    make_embedder: Callable[[], Embedder] = hashed_words
    batch: int = 16
    concurrency: int = 4
    force: bool = False
    dry_run: bool = False
    clean_stale: bool = False
    retry_wait: float = 5.0
    ignore: dict[str, list[str]] = field(default_factory=dict)
    gitignore: bool = True
    root: str = ""
    ticket_filter: str = ""
    keep_deprecated: bool = False
    recreate: bool = False
    exclusive: bool = False

    @property
    def embedding_model(self) -> str:
        return self.model or "nomic-embed-text"


def enrich(pieces: DataFrame, domain: str, source_type: str, registry: dict | None = None) -> DataFrame:
    """Chunk rows of pieces(source, rel_path, ext, chunk_index, text, chunk_meta)."""
    meta = lambda k: F.coalesce(F.try_element_at("chunk_meta", F.lit(k)), F.lit(""))
    found: Column = F.array_union(M.concepts(F.col("text"), domain, registry), concept_parts(meta("concepts")))
    given = meta("content_type")
    return pieces.select(
        "source", "chunk_index", "text",
        chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")).alias("chunk_id"),
        F.lit(source_type).alias("source_type"), F.lit(domain).alias("domain"),
        M.repository(F.col("rel_path")).alias("repository"),
        F.when(given != "", given).otherwise(M.content_type(F.col("text"))).alias("content_type"),
        F.array_sort(found).alias("concepts"),
        (M.dependencies(F.col("text"), F.col("ext")) if source_type == "code" else F.lit("")).alias("dependencies"),
        F.map_concat("chunk_meta", F.create_map(F.lit("relative_path"), M.relative_path(F.col("rel_path")), F.lit("extension"), F.col("ext"))).alias("extra"),
    )


def plan(spark: SparkSession, sources: DataFrame, options: Options) -> DataFrame:
    """Chunks of sources(source, rel_path, ext, text), without vectors."""
    kind = SOURCE_TYPE_BY_MODE.get(options.mode, "domain_doc")
    typed = within_limit(sources.withColumn("source_type", F.lit(kind)))
    pieces = chunk(typed, options.embedding_model, ["rel_path", "ext"], M.parse_ticket_filter(options.ticket_filter), options.keep_deprecated, [kind])
    return enrich(pieces, options.domain, kind, options.registry)


def ingest(spark: SparkSession, store_folder: str, sources: DataFrame | str, options: Options, changes: DataFrame | None = None, head: str | None = None) -> dict:
    """Run one ingestion; returns its manifest record. Only new or changed sources are chunked and embedded.

    A folder is looked through whole, so recorded sources below it that are not there have vanished: they leave the
    record, with clean_stale their chunks too. Sources given as rows say nothing of others, unless options.root names
    the folder of which they are all.
    """
    began, run_id = time.time(), uuid4().hex
    store = ChunkStore(spark, store_folder)
    name = resolve_collection(options.mode, options.domain, options.collection)
    state = store.state()
    stored = state["collections"].get(name, {}).get("dimension")
    options = replace(options, model=detect_model(options.model, state["config"], stored))
    root = sources.rstrip("/") if isinstance(sources, str) else options.root.rstrip("/") or None
    if isinstance(sources, str):
        found_rules = discover_ignores(spark, sources) if options.gitignore else {}
        sources = scan(spark, sources, options.mode, {**found_rules, **options.ignore})
    found = csv_rows(sources) if options.mode in ("rally", "customer") else sources
    if changes is not None:
        found, gone_paths = changed(found, changes)
        gone = gone_paths.select((F.concat(F.lit(f"{root}/"), "path") if root else F.col("path")).alias("source"))
        removed = gone
    else:
        gone = store.vanished(found, name, root)
        removed = gone if options.clean_stale else None
    todo = store.unseen(found, name, options.force)
    if options.dry_run:
        return {"collection": name, "files_processed": todo.count(), "chunks": plan(spark, todo, options).count(), "dry_run": True}
    # what a run works on and what it has embedded are written down, so that lost executors never embed twice
    with store.hold(name, run_id) if options.exclusive else nullcontext(), store.staging(run_id) as stage:
        done = stage(todo.select("source", "md5"), "sources", n=F.count(F.lit(1)))
        chunks = plan(spark, todo, options)
        embedded = embed_chunks(chunks, options.make_embedder, options.batch, wait=options.retry_wait, concurrency=options.concurrency)
        vectors = stage(embedded.withColumn("collection", F.lit(name)), "chunks", width=F.max(F.size("embedding")))
        good, failed = split_failed(vectors)
        failed = stage(failed, "failed", n=F.count(F.lit(1)))
        width = stage.seen["chunks"]["width"]
        width = width if width and width > 0 else None
        if width:
            store.check_dimension(name, width, options.recreate)
        gone = stage(gone.select("source"), "gone")
        counts = store.upsert(
            name, good.join(failed, "source", "left_anti"), run_id, failed, gone=gone if removed is not None else None,
            seen=done, forget=gone, head=head, config={"embedding_model": options.model}, dimension=width,
        )
        store.compact(name)
        counted = store.tally(run_id, vectors).collect()  # a row for each content type and each name of a concept
        record = {
            "ingestion_id": run_id, "mode": options.mode, "domain": options.domain, "collection": name,
            "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(began)),
            "files_processed": stage.seen["sources"]["n"], "chunks_created": counts.created, "chunks_updated": counts.updated,
            "chunks_upserted": counts.created + counts.updated, "chunks_deleted_stale": counts.deleted,
            "concepts_found": sorted(r.value for r in counted if r.kind == "concept"),
            "content_type_distribution": {r.value: r.n for r in counted if r.kind == "content_type"},
            "embedding_model": options.model, "duration_seconds": round(time.time() - began, 3), "errors": stage.seen["failed"]["n"],
        }
    store.append_run(record)
    return record


def feed(spark: SparkSession, store_folder: str, source: str, text: str, options: Options) -> dict:
    """Ingest one document, replacing what the store holds of it."""
    rows = spark.createDataFrame([(source, source.rpartition("/")[2], text)], "source string, rel_path string, text string")
    rows = rows.withColumn("ext", F.lower(F.regexp_extract("rel_path", r"(\.[^.]+)$", 1))).withColumn("md5", F.md5("text"))
    kind = "rfc" if options.mode == "auto" and rows.filter(F.col("rel_path").rlike(r"(?i)rfc\d+.*\.txt$")).count() else options.mode
    options = Options(**{**vars(options), "mode": "domain" if kind == "auto" else kind, "force": True})
    return ingest(spark, store_folder, rows, options)

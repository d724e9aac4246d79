"""Collections on Parquet: a store of small immutable runs, merged on read and in tiers, with versioned commits.

A write adds one run to its collection: the chunks it brings (`rows`), the ids of older chunks that they replace or that
went stale (`kills`), and what became of the sources (`seen`). Nothing that is there is rewritten, so feeding one document
writes as many rows as the document has, whatever the store holds. Reading takes the rows of all runs less those that a
later run kills. Runs of similar size are merged now and then (`compact`), so every row is rewritten about as often as
the store has tiers, and runs stay few.

The state of the whole store is one small JSON file per version, `versions/<number>.json`. A commit writes the next
number and succeeds only if nobody has: the file is put in its place without overwriting (a hard link on a local disk,
a rename that fails on existing files elsewhere; the file system must make that atomic, as HDFS does). Whoever loses
reads the new state and tries again: other collections are carried over, and where its own collection has moved on, the
kills are worked out anew. Chunks, checkpoint, head and configuration are of the same version, so a reader sees all of
a run or nothing. A damaged version file is an error, never an empty store. Folders that no version names stay until
vacuum().
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import md5
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_SCHEMA = """collection string, chunk_id string, source string, chunk_index int, text string, source_type string,
domain string, repository string, content_type string, concepts array<string>, dependencies string,
embedding array<float>, run_id string, extra map<string,string>"""
RUN_SCHEMA = """ingestion_id string, mode string, domain string, collection string, timestamp string, files_processed long,
chunks_created long, chunks_updated long, chunks_upserted long, chunks_deleted_stale long, concepts_found array<string>,
content_type_distribution map<string,long>, embedding_model string, duration_seconds double, errors long"""
PROGRESS_SCHEMA = """event string, query string, query_id string, run_id string, timestamp string, batch_id long, input_rows long,
milliseconds long, state_rows long, observed map<string,map<string,string>>, error string"""
SCHEMAS = {"rows": CHUNK_SCHEMA, "kills": "collection string, chunk_id string", "seen": "collection string, source string, md5 string"}


class DimensionMismatch(ValueError):
    """Stored vectors have another length than the embedder's."""


class DamagedState(ValueError):
    """A state file cannot be read; going on as if it were empty would lose data."""


class Conflict(RuntimeError):
    """Other writers came first, again and again; nothing of this write is in the store."""


class Busy(RuntimeError):
    """Another run holds the collection."""


@dataclass(frozen=True)
class RunCounts:
    created: int
    updated: int
    deleted: int


def unseen(sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources whose content hash is not the one in seen(source, md5)."""
    joined = sources.join(seen.select("source", F.col("md5").alias("old_md5")), "source", "left")
    return joined.filter(~F.col("md5").eqNullSafe(F.col("old_md5"))).drop("old_md5")


def vanished(seen: DataFrame, sources: DataFrame, root: str | None = None) -> DataFrame:
    """Sources of seen below root that are not there any more: those outside of it were not looked for.

    Without a root nothing was looked for but the sources themselves, and nothing counts as gone; the empty root is
    above all. Ticket and web keys are exempt, rows of a table go with its file.
    """
    if root is None:
        return seen.select("source").limit(0)
    on_disk = lambda c: F.when(c.startswith("csv:"), F.regexp_extract(c, "^csv:(.*):[^:]*$", 1)).otherwise(c)
    there = sources.select(on_disk(F.col("source")).alias("file")).distinct()
    known = seen.filter(~F.col("source").rlike("^(rally:|http)")).withColumn("file", on_disk(F.col("source")))
    if root.rstrip("/"):
        known = known.filter(F.col("file").startswith(root.rstrip("/") + "/"))
    return known.join(there, "file", "left_anti").select("source")


def fates(old: DataFrame, fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """old with what becomes of each row: replaced (its chunk_id is fresh), stale (its source is), or kept."""
    marks = fresh.select("chunk_id").distinct().withColumn("hit", F.lit(True))
    joined = old.join(marks, "chunk_id", "left").join(stale.select("source").distinct().withColumn("stale", F.lit(True)), "source", "left")
    return joined.withColumn("fate", F.when(F.col("hit"), "replaced").when(F.col("stale"), "stale").otherwise("kept")).drop("hit", "stale")


def live(rows: DataFrame, kills: DataFrame) -> DataFrame:
    """rows(collection, chunk_id, seq, ...) that no later one of kills(collection, chunk_id, seq) removes."""
    dead = kills.select(F.col("collection").alias("_in"), F.col("chunk_id").alias("_id"), F.col("seq").alias("_at"))
    same = (F.col("collection") == F.col("_in")) & (F.col("chunk_id") == F.col("_id"))
    return rows.join(dead, same & (F.col("seq") < F.col("_at")), "left_anti")


def latest(seen: DataFrame) -> DataFrame:
    """What the last of seen(collection, source, md5, seq) says of each source; a null hash means that it has gone."""
    return seen.groupBy("collection", "source").agg(F.max_by("md5", "seq").alias("md5"), F.max("seq").alias("seq"))


def mergeable(sizes: list[int], fanout: int = 4) -> int:
    """How many of the newest runs to merge, sizes given from the oldest on: most runs whose largest is no larger than all others."""
    for n in range(len(sizes), fanout - 1, -1):
        if max(sizes[-n:]) <= sum(sizes[-n:]) - max(sizes[-n:]):
            return n
    return 0


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str, tries: int = 20) -> None:
        self.spark, self.tries = spark, tries
        given = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
        self._fs = given.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(given).toString().rstrip("/")

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since the last change) of a folder's entries."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        now = time.time()
        return [(f.getPath().getName(), now - f.getModificationTime() / 1000) for f in self._fs.listStatus(path)]

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read_json(self, name: str, default, strict: bool = False):
        """A small state file, or the default where it is missing or damaged; if strict, a damaged one raises DamagedState."""
        if not self._fs.exists(self._path(name)):
            return default
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError as wrong:
            if not strict:
                return default
            raise DamagedState(f"{self.folder}/{name} is no JSON") from wrong
        finally:
            stream.close()

    def _put(self, name: str, value) -> bool:
        """Write a file that must not be there yet, whole or not at all; False if it is there."""
        aside, target = self._path(f".{uuid4().hex}.tmp"), self._path(name)
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(aside, target, self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Py4JJavaError as wrong:
            if "FileAlreadyExists" in wrong.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(aside, False)

    @contextmanager
    def staging(self, run_id: str) -> Iterator[Callable[..., DataFrame]]:
        """A place for the tables of one run, removed when it ends: stage(rows, name) writes and reads back.

        Named aggregates are taken while writing: stage.seen[name] has them.
        """
        folder = f"staging-{run_id}"

        def stage(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
            path = f"{self.folder}/{folder}/{name}"
            stage.seen[name] = _observed(rows, path, **measures)
            return self.spark.read.schema(rows.schema).parquet(path)

        stage.seen = {}
        try:
            yield stage
        finally:
            self._fs.delete(self._path(folder), True)

    # versions

    def state(self) -> dict:
        """The newest version: {version, collections: {name: {runs, next, git_head, dimension}}, config}."""
        numbers = [int(n.removesuffix(".json")) for n, _ in self._names("versions") if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "collections": {}, "config": {}}
        return self.read_json(f"versions/{max(numbers):012d}.json", None, strict=True)

    def commit(self, change: Callable[[dict], dict | None]) -> int:
        """Make change(state) the next version; where others come first it is asked again about theirs. None means no change."""
        for attempt in range(self.tries):
            now = self.state()
            new = change(json.loads(json.dumps(now)))
            if new is None:
                return now["version"]
            new["version"] = now["version"] + 1
            if self._put(f"versions/{new['version']:012d}.json", new):
                return new["version"]
            time.sleep(min(0.5, 0.01 * 2**attempt))
        raise Conflict(f"{self.folder}: {self.tries} commits lost to other writers")

    @staticmethod
    def _of(state: dict, collection: str) -> dict:
        return state["collections"].setdefault(collection, {"runs": [], "next": 1, "git_head": None, "dimension": None})

    def version(self) -> str:
        """A name of the current contents."""
        runs = {name: [r["token"] for r in c["runs"]] for name, c in self.state()["collections"].items()}
        return md5(json.dumps(runs, sort_keys=True).encode()).hexdigest()

    @contextmanager
    def hold(self, collection: str, owner: str, seconds: float = 6 * 3600) -> Iterator[None]:
        """Keep a collection for one run: raises Busy while another one's time has not run out."""

        def take(state: dict) -> dict:
            lease = self._of(state, collection).get("lease")
            if lease and lease["until"] > time.time() and lease["owner"] != owner:
                raise Busy(f"{collection} is being written by {lease['owner']}")
            state["collections"][collection]["lease"] = {"owner": owner, "until": time.time() + seconds}
            return state

        def leave(state: dict) -> dict | None:
            mine = (self._of(state, collection).get("lease") or {}).get("owner") == owner
            state["collections"][collection]["lease"] = None
            return state if mine else None

        self.commit(take)
        try:
            yield
        finally:
            self.commit(leave)

    # runs

    def _read(self, state: dict, kind: str, collection: str | None = None, runs: list[dict] | None = None) -> DataFrame | None:
        """One kind of table of some runs, with the seq of the run that each row is of; None if they have none."""
        if runs is None:
            runs = [r for name, c in state["collections"].items() if collection in (None, name) for r in c["runs"]]
        known = {r["token"]: r["seq"] for r in runs if r[kind]}
        if not known:
            return None
        rows = self.spark.read.schema(SCHEMAS[kind]).parquet(*(f"{self.folder}/data/{t}/{kind}" for t in known))
        numbers = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        token = F.regexp_extract(F.col("_metadata.file_path"), f"/([0-9a-f]{{32}})/{kind}/[^/]*$", 1)
        return rows.select("*", F.element_at(numbers, token).alias("seq"))

    def _live(self, state: dict, collection: str | None = None, runs: list[dict] | None = None) -> DataFrame:
        rows = self._read(state, "rows", collection, runs)
        if rows is None:
            return self.spark.createDataFrame([], f"{CHUNK_SCHEMA}, seq int")
        kills = self._read(state, "kills", collection, runs)
        return rows if kills is None else live(rows, kills)

    def _write(self, token: str, kind: str, rows: DataFrame, **measures: Column) -> dict:
        columns = [c.split()[0] for c in SCHEMAS[kind].replace("\n", " ").split(", ")]
        return _observed(rows, f"{self.folder}/data/{token}/{kind}", columns, n=F.count(F.lit(1)), **measures)

    # chunks

    def chunks(self, collection: str | None = None) -> DataFrame:
        """All chunks, or those of one collection."""
        return self._live(self.state(), collection).drop("seq")

    def upsert(
        self, collection: str, rows: DataFrame, run_id: str, failed: DataFrame | None = None, complete: bool = True, gone: DataFrame | None = None,
        seen: DataFrame | None = None, forget: DataFrame | None = None, head: str | None = None, config: dict | None = None, dimension: int | None = None,
    ) -> RunCounts:
        """Add or replace chunks of a collection by id; of re-ingested sources that did not fail, rows of earlier runs go.

        The chunks of gone(source) go in the same commit. So does the record of the sources: seen(source, md5) without
        those that failed is noted, forget(source) leaves it; the head moves on runs without failures only.
        """
        token = uuid4().hex
        fresh = rows.withColumn("run_id", F.lit(run_id)).withColumn("collection", F.lit(collection)).dropDuplicates(["chunk_id"])
        kinds = StructType.fromDDL(CHUNK_SCHEMA.replace("\n", " "))
        fresh = fresh.select(*[(F.col(k.name) if k.name in fresh.columns else F.lit(None)).cast(k.dataType).alias(k.name) for k in kinds])
        fresh = fresh.sortWithinPartitions("source", "chunk_index")
        n = self._write(token, "rows", fresh)["n"]
        fresh = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{self.folder}/data/{token}/rows").select("chunk_id", "source")
        stale = fresh.select("source").distinct() if complete else fresh.select("source").limit(0)
        if failed is not None:
            stale = stale.join(failed.select("source"), "source", "left_anti")
        if gone is not None:
            stale = stale.unionByName(gone.select("source")).distinct()
        noted = self._note(token, collection, seen, failed, forget)
        broken = failed is not None and head is not None and not failed.isEmpty()
        for _ in range(self.tries):
            base = self.state()
            fate = fates(self._live(base, collection).select("chunk_id", "source"), fresh, stale).filter("fate <> 'kept'")
            counts = self._write(token, "kills", fate.withColumn("collection", F.lit(collection)),
                                 updated=F.count_if(F.col("fate") == "replaced"), deleted=F.count_if(F.col("fate") == "stale"))
            run = {"token": token, "rows": n, "kills": counts["n"], "seen": noted}

            def add(state: dict) -> dict | None:
                own = self._of(state, collection)
                if own["runs"] != self._of(base, collection)["runs"]:  # noqa: B023
                    raise _Moved
                changes = (head if not broken else None, dimension, (config or {}).items() - state["config"].items())
                if not any(run[k] for k in SCHEMAS) and not any(changes):  # noqa: B023
                    return None
                if any(run[k] for k in SCHEMAS):  # noqa: B023
                    own["runs"].append({**run, "seq": own["next"]})  # noqa: B023
                    own["next"] += 1
                own["git_head"], own["dimension"] = changes[0] or own["git_head"], dimension or own["dimension"]
                state["config"] |= config or {}
                return state

            try:
                self.commit(add)
            except _Moved:
                self._fs.delete(self._path(f"data/{token}/kills"), True)
                continue
            return RunCounts(n - counts["updated"], counts["updated"], counts["deleted"])
        raise Conflict(f"{collection} has moved on {self.tries} times during one write")

    def _note(self, token: str, collection: str, seen: DataFrame | None, failed: DataFrame | None, forget: DataFrame | None) -> int:
        """Write what a run says of its sources: hashes of those that are done, nulls for those to be ingested again."""
        noted = None
        if seen is not None:
            noted = seen.select("source", "md5")
            noted = noted if failed is None else noted.join(failed.select("source"), "source", "left_anti")
        for leaving in (failed, forget):
            if leaving is not None:
                gone = leaving.select("source", F.lit(None).cast("string").alias("md5"))
                noted = gone if noted is None else noted.unionByName(gone)
        if noted is None:
            return 0
        once = noted.groupBy("source").agg(F.max("md5").alias("md5")).withColumn("collection", F.lit(collection))
        return self._write(token, "seen", once)["n"]

    def delete_sources(self, collection: str, gone: DataFrame) -> int:
        """Remove the chunks of gone(source) from a collection; only their ids are written."""
        none = self.spark.createDataFrame([], CHUNK_SCHEMA)
        return self.upsert(collection, none, uuid4().hex, complete=False, gone=gone).deleted

    def compact(self, collection: str, fanout: int = 4) -> int:
        """Merge the newest runs of similar size, or all where half of the rows are dead; returns the rows written.

        Writers that add runs meanwhile are not disturbed; where another merge came first this one is given up.
        """
        base = self.state()
        runs = self._of(base, collection)["runs"]
        n = mergeable([sum(r[k] for k in SCHEMAS) for r in runs], fanout)
        if 2 * sum(r["kills"] for r in runs) > sum(r["rows"] for r in runs) and len(runs) > 1:
            n = len(runs)
        if not n:
            return 0
        part, token, kept = runs[-n:], uuid4().hex, {}
        tables = {"rows": self._live(base, runs=part), "kills": self._read(base, "kills", runs=part), "seen": self._read(base, "seen", runs=part)}
        if n == len(runs):
            tables["kills"] = None
        for kind, rows in tables.items():
            if rows is not None:
                if kind == "kills":
                    rows = rows.select("collection", "chunk_id").distinct()
                elif kind == "seen":
                    rows = latest(rows)
                    rows = rows.filter("md5 IS NOT NULL") if n == len(runs) else rows
                else:
                    rows = rows.repartitionByRange("source", "chunk_index").sortWithinPartitions("source", "chunk_index")
                kept[kind] = self._write(token, kind, rows)["n"]
        merged = {"token": token, "seq": part[-1]["seq"], **{k: kept.get(k, 0) for k in SCHEMAS}}

        def swap(state: dict) -> dict | None:
            own = self._of(state, collection)
            if own["runs"][: len(runs)] != runs:
                return None
            own["runs"] = [*runs[:-n], merged, *own["runs"][len(runs) :]]
            return state

        self.commit(swap)
        return merged["rows"]

    def vacuum(self, grace: float = 3600.0) -> int:
        """Delete older versions and the folders that only they name; what is younger than grace may belong to a run at work."""
        state = self.state()
        named = {r["token"] for c in state["collections"].values() for r in c["runs"]}
        gone = [f"data/{f}" for f, age in self._names("data") if f not in named and age >= grace]
        gone += [f for f, age in self._names("") if f.startswith(("bm25-", "cells-")) and not f.endswith(f"-{self.version()}") and age >= grace]
        for name in gone:
            self._fs.delete(self._path(name), True)
        for name, age in self._names("versions"):
            if name.endswith(".json") and int(name.removesuffix(".json")) < state["version"] and age >= grace:
                self._fs.delete(self._path(f"versions/{name}"), False)
        return len(gone)

    def check_dimension(self, collection: str, dimension: int, recreate: bool = False) -> bool:
        """Compare the stored vectors' length with the embedder's; on a mismatch drop the collection or raise."""
        stored = self._of(self.state(), collection)["dimension"]
        if stored is None:
            row = self.chunks(collection).filter(F.col("embedding").isNotNull()).select(F.size("embedding")).head()
            stored = row and row[0]
        if stored in (None, dimension):
            return True
        if not recreate:
            raise DimensionMismatch(f"{collection} holds vectors of {stored}, the embedder makes {dimension}")

        def drop(state: dict) -> dict:
            self._of(state, collection).update(runs=[], git_head=None, dimension=None)
            return state

        self.commit(drop)
        return False

    # checkpoint

    def checkpoint(self, collection: str) -> DataFrame:
        """(source, md5) of what has been ingested."""
        seen = self._read(self.state(), "seen", collection)
        if seen is None:
            return self.spark.createDataFrame([], "source string, md5 string")
        return latest(seen).filter("md5 IS NOT NULL").select("source", "md5")

    def unseen(self, sources: DataFrame, collection: str, force: bool = False) -> DataFrame:
        """Sources whose content hash is not the recorded one; all with force."""
        if force:
            return sources
        return unseen(sources, self.checkpoint(collection))

    def vanished(self, sources: DataFrame, collection: str, root: str | None) -> DataFrame:
        """Recorded sources below root that are not on disk any more."""
        return vanished(self.checkpoint(collection), sources, root)

    def git_head(self, collection: str) -> str | None:
        return self._of(self.state(), collection)["git_head"]

    def migrate_checkpoint(self, legacy: dict[str, str], collection: str) -> None:
        """Take over a flat {source: md5} mapping, once: not where the collection has a record of its own."""
        if legacy and self._read(self.state(), "seen", collection) is None:
            none = self.spark.createDataFrame([], CHUNK_SCHEMA)
            self.upsert(collection, none, uuid4().hex, complete=False, seen=self.spark.createDataFrame(list(legacy.items()), "source string, md5 string"))

    # manifests

    def append_run(self, record: dict) -> None:
        """One file a run, which no other writer touches."""
        self._put(f"runs/{record['ingestion_id']}.json", record)

    def runs(self) -> DataFrame:
        """The records of all runs."""
        return self._records("runs", RUN_SCHEMA)

    def append_progress(self, name: str, record: dict) -> None:
        """One file an event of a stream; told again it stays as it is."""
        self._put(f"progress/{name}.json", record)

    def progress(self) -> DataFrame:
        """The recorded events of streams."""
        return self._records("progress", PROGRESS_SCHEMA)

    def _records(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.folder}/{name}") if self.exists(name) else self.spark.createDataFrame([], schema)

    def tally(self, run_id: str, rows: DataFrame) -> DataFrame:
        """Chunks of a run by content type and by concept, all of them, counted in one pass and kept: (kind, value, n)."""
        marked = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        of_row = F.concat(F.array(marked("content_type", F.col("content_type"))), F.transform("concepts", lambda c: marked("concept", c)))
        found = rows.select(F.explode(of_row).alias("at")).groupBy("at.kind", "at.value").agg(F.count(F.lit(1)).alias("n"))
        path = f"{self.folder}/tallies/run_id={run_id}"
        found.coalesce(1).write.parquet(path)  # as many rows as there are types and concepts
        return self.spark.read.schema(found.schema).parquet(path)

    def tallies(self) -> DataFrame:
        """(run_id, kind, value, n) of all runs."""
        schema = "kind string, value string, n long, run_id string"
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/tallies") if self.exists("tallies") else self.spark.createDataFrame([], schema)
        return rows.select("run_id", "kind", "value", "n")

    def repositories(self) -> DataFrame:
        """Files per collection and repository."""
        return self.chunks().groupBy("collection", "repository").agg(F.countDistinct("source").alias("files"))


class _Moved(Exception):
    """The collection is not what the kills were worked out from."""


def _observed(rows: DataFrame, path: str, columns: list[str] | None = None, **measures: Column) -> dict:
    """Write rows as Parquet and take aggregates of them in the same job."""
    if measures:
        seen = Observation()
        rows = rows.observe(seen, *[c.alias(n) for n, c in measures.items()])
    (rows.select(*columns) if columns else rows).write.parquet(path)
    return seen.get if measures else {}

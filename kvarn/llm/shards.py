"""Size-tiered sharding: small immutable runs, merged by size into target-sized files, behind a versioned manifest.

An append writes its rows once, as new files of new runs, and commits a manifest version that lists them. A
compaction looks at the sizes of the runs only: runs whose sizes fall in one tier (powers of `fanout`) are merged
`fanout` at a time, oldest first, and all merges of a round are one job whose files have about `target_bytes`;
rounds repeat until no tier is full, which takes about log(runs) rounds. A manifest version is one file, written
aside and renamed without overwriting: of two writers that start from one version one fails, and a reader sees a
whole version or none. Data files are never changed; superseded ones stay readable until vacuum() removes what no kept
version lists. A merge deals the rows of a group in turn to its files and places each file on a partition of its own,
so neither repeated rows nor chance put two files on one task. The rows are moved by DataFrame operations alone; the
driver handles file names and sizes.

Nulls and edge cases: any column may hold nulls (rows whose arrival cannot be told form an arrival of their own);
repeated rows are kept as often as they occur; an empty table commits a version without runs; columns may have any
name that does not start with `__shard_`.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .base import scratch, small_side, table

RUN, FILE = "__shard_run", "__shard_file"


class CommitConflict(RuntimeError):
    """Another writer has committed the version in between."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    files: int


class ShardedTable:
    """A table of immutable runs below one folder of any file system that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, base_bytes: int = 1 << 20,
                 target_bytes: int = 128 << 20, max_run_bytes: int = 1 << 40) -> None:
        self.spark, self.folder = spark, folder
        self.fanout, self.base_bytes, self.target_bytes, self.max_run_bytes = fanout, base_bytes, target_bytes, max_run_bytes
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.Path(f"{self.folder}/{name}" if name else self.folder)

    # manifest

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"manifest/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self.manifest(version)["runs"]]

    def _commit(self, parent: int, schema: str | None, runs: list[Run]) -> int:
        version = parent + 1
        aside = self._path(f"manifest/.{uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "runs": [vars(r) for r in runs]}).encode()))
        out.close()
        context = self._jvm.FileContext.getFileContext(aside.toUri(), self._conf) if aside.toUri().getScheme() else self._jvm.FileContext.getFileContext(self._conf)
        plain = self.spark._sc._gateway.new_array(getattr(self._jvm, "Options$Rename"), 0)
        try:
            context.rename(aside, self._path(f"manifest/v{version:08d}.json"), plain)
        except Exception as failed:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(failed):
                raise CommitConflict(f"version {version} exists") from failed
            raise
        return version

    # data

    def _write(self, rows: DataFrame) -> list[Run]:
        """Write rows that carry RUN (and maybe FILE) and return the runs found below a fresh folder."""
        batch = f"data/{uuid4().hex}"
        keys = [c for c in (RUN, FILE) if c in rows.columns]
        rows.write.option("compression", "zstd").partitionBy(*keys).parquet(f"{self.folder}/{batch}")
        found = []
        for status in self._fs.listStatus(self._path(batch)):
            name = status.getPath().getName()
            if name.startswith(f"{RUN}="):
                size = self._fs.getContentSummary(status.getPath())
                found.append(Run(f"{batch}/{name}", size.getLength(), size.getFileCount()))
        return sorted(found, key=lambda r: int(r.name.rpartition("=")[2]))

    def _read(self, runs: list[Run], schema: str) -> DataFrame:
        fields = StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], fields)
        folders = [f"{self.folder}/{r.name}" for r in runs]
        return self.spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(*folders)

    def append(self, rows: DataFrame, arrival: Column | None = None) -> int:
        """Write rows as one small run per value of arrival (a long; all rows are one arrival by default)."""
        now = self.manifest()
        runs = self._write(rows.withColumn(RUN, F.coalesce(arrival if arrival is not None else F.lit(0), F.lit(-1)).cast("long")))
        return self._commit(now["version"], now["schema"] or rows.schema.json(), [Run(**r) for r in now["runs"]] + runs)

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(run.bytes, 1) / self.base_bytes, self.fanout)))

    def plan(self, runs: list[Run]) -> list[list[Run]]:
        """Groups of similarly sized runs to merge, oldest first; the newest files of a tier wait until it is full."""
        tiers: dict[int, list[Run]] = {}
        for run in runs:
            if run.bytes < self.max_run_bytes:
                tiers.setdefault(self.tier(run), []).append(run)
        return [own[k : k + self.fanout] for own in tiers.values() for k in range(0, len(own) - self.fanout + 1, self.fanout)]

    def compact(self, order_by: str | None = None, keep: int | None = None) -> int:
        """Merge until no tier is full; returns the version. With keep, vacuum(keep) follows each round."""
        now = self.manifest()
        while groups := self.plan([Run(**r) for r in now["runs"]]):
            merged = self._merge(groups, now["schema"], order_by)
            gone = {r.name for g in groups for r in g}
            version = self._commit(now["version"], now["schema"], [Run(**r) for r in now["runs"] if r["name"] not in gone] + merged)
            if keep:
                self.vacuum(keep)
            now = self.manifest(version)
        return now["version"]

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest `keep` versions, and delete the runs that only those listed; returns how many went.

        Runs that no version lists (those of a failed or unfinished writer) are left alone.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        listed = {r.name for v in kept for r in self.runs(v)}
        gone = {r.name for v in old for r in self.runs(v)} - listed
        for version in old:
            self._fs.delete(self._path(f"manifest/v{version:08d}.json"), False)
        for name in gone:
            self._fs.delete(self._path(name), True)
        return len(gone)

    def _merge(self, groups: list[list[Run]], schema: str, order_by: str | None) -> list[Run]:
        """One job for all groups of a round: the rows of a group go in turn to its files, one file a partition."""
        files = [max(1, -(-sum(r.bytes for r in group) // self.target_bytes)) for group in groups]
        places = [(r.name, k, sum(files[:k]), files[k]) for k, group in enumerate(groups) for r in group]
        rows = self._read([r for group in groups for r in group], schema)
        named = rows.withColumn("__shard_name", F.regexp_extract(F.input_file_name(), r"(data/[^/]+/[^/]+)/", 1))
        named = named.withColumn("__shard_turn", F.monotonically_increasing_id())
        target = self.spark.createDataFrame(places, f"__shard_name string, {RUN} long, __shard_first int, __shard_files int")  # one row a run
        rows = named.join(small_side(target, len(places)), "__shard_name")
        rows = rows.withColumn(FILE, (F.col("__shard_first") + F.pmod("__shard_turn", "__shard_files")).cast("int"))
        rows = rows.drop("__shard_name", "__shard_turn", "__shard_first", "__shard_files").repartitionById(sum(files), F.col(FILE))
        return self._write(rows.sortWithinPartitions(RUN, FILE, *([order_by] if order_by else [])))

    def snapshot(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been committed")
        return self._read([Run(**r) for r in now["runs"]], now["schema"])


def op3(spark, sf_dir: str, arrivals: int = 20) -> DataFrame:
    """documents, appended in arrivals, compacted, and read back from the committed manifest."""
    shards = ShardedTable(spark, scratch(spark, "shards"))
    docs = table(spark, sf_dir, "documents")
    shards.append(docs, F.pmod("doc_id", F.lit(arrivals)))
    shards.compact("doc_id", keep=1)
    return shards.snapshot().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5")
    )


SQL = "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"

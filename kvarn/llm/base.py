"""Shared plumbing of the training-data operators: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The setting is read from the session. Where it is unset a local folder is made and registered, but only for a
    local master: on a cluster other machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='kvarn-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kvarn/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str, done: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and survives lost executors.

    The path goes to the list done, for tables that a caller discards once nothing depends on them.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    if done is not None:
        done.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, done: list[str]) -> None:
    """Delete stashed tables that have served their purpose."""
    for path in done:
        drop_path(spark, path)
    done.clear()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark knows."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small_side(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the counted rows stay below the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """An Arrow function whose worker, which Spark keeps for later tasks, hands freed memory back when a task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped

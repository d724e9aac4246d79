"""Spark session with the settings the engine is tuned for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName("kvarn")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder; a local one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='kvarn-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kvarn/{tag}-{uuid.uuid4().hex}"


def stash(rows: DataFrame, tag: str) -> DataFrame:
    """Write rows to the shared folder and read them back: worked out once, and lost executors cost nothing."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

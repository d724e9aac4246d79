"""Structured Streaming: incremental ingestion of files, and event windows as an extension beyond the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import decode
from ..plans.ingest import Options, ingest
from ..sources.readers import extension, page_sources, ticket_sources, wanted


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, options: Options) -> StreamingQuery:
    """Ingest all files not seen yet, then stop. The stream's checkpoint gives each file once, the hash each content once."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    base = folder.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace("path", rf"^.*\Q{base}\E/", "")
    rows = files.withColumn("rel_path", rel).filter(wanted(F.col("rel_path"), options.mode)).select(
        F.concat(F.lit(f"{base}/"), F.col("rel_path")).alias("source"), "rel_path", extension(F.col("rel_path")).alias("ext"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), decode(F.col("content")).alias("text"),
    )

    def batch(found: DataFrame, _: int) -> None:
        if not found.isEmpty():
            ingest(found.sparkSession, store, found, options, changes=found.sparkSession.createDataFrame(
                [], "path string, op string").unionByName(found.select(F.col("rel_path").alias("path"), F.lit("M").alias("op"))))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark: SparkSession, source: str, store: str, checkpoint: str, options: Options, page_size: int = 100, label: str | None = None) -> StreamingQuery:
    """Ingest tickets (mode rally or customer) or wiki pages from a registered page source, one page a batch.

    A fetch that fails ends the query; started again with the same checkpoint it goes on with that page. A page that was
    ingested before its batch was recorded is known by its hashes and not ingested twice.
    """
    pages = spark.readStream.format(source).option("page_size", page_size).load()

    def batch(found: DataFrame, _: int) -> None:
        rows = page_sources(found, label) if options.mode == "wiki" else ticket_sources(found)
        if not rows.isEmpty():
            ingest(found.sparkSession, store, rows, options)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window; works on streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end and events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")

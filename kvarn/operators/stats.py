"""Status and statistics: exact aggregates over all chunks, no samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct sources and the latest ingestion of each collection."""
    return chunks.groupBy("collection").agg(
        F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.max("ingested").alias("latest")
    )


def top_concepts(chunks: DataFrame, n: int = 15) -> DataFrame:
    counted = chunks.select(F.explode("concepts").alias("concept")).groupBy("concept").agg(F.count("*").alias("chunks"))
    return counted.orderBy(F.desc("chunks"), "concept").limit(n)


def content_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count("*").alias("chunks"))


def repositories(chunks: DataFrame) -> DataFrame:
    """Files and the mix of source types of each repository."""
    kinds = F.col("source_type")
    return chunks.groupBy("repository").agg(
        F.countDistinct("source").alias("files"),
        F.count_if(kinds == "rfc").alias("rfc"),
        F.count_if(kinds.isin("rally", "customer")).alias("tickets"),
        F.count_if(kinds == "mib").alias("mib"),
    )


def feed_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct sections and all concepts of each source."""
    section = F.when(F.trim("section") != "", F.trim("section"))
    base = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct(section).alias("sections"))
    tagged = chunks.select("source", F.explode("concepts").alias("c")).groupBy("source").agg(F.array_sort(F.collect_set("c")).alias("concepts"))
    none = F.array().cast("array<string>")
    return base.join(tagged, "source", "left").withColumn("concepts", F.coalesce("concepts", none))

"""Embedding as a pluggable Arrow operator, with retries, batch halving and failures as data."""

from __future__ import annotations

import threading
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]


def hashed_words(dimension: int = 64) -> Embedder:
    """Deterministic offline embedder: signed hashed word counts of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode("utf-8", "replace"))
                out[k, h % dimension] += 1 if h >> 16 & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return embed


def with_retry(embed: Embedder, texts: list[str], tries: int = 5, wait: float = 5.0) -> list[list[float] | None]:
    """Vectors of texts; a batch that keeps failing is halved, a single text that keeps failing is None."""
    for attempt in range(tries):
        try:
            vectors = embed(texts)
            if len(vectors) == len(texts):
                return vectors
        except Exception:  # any failure of the remote side counts as one try
            pass
        if attempt + 1 < tries:
            time.sleep(wait)
    if len(texts) <= 1:
        return [None] * len(texts)
    half = len(texts) // 2
    return with_retry(embed, texts[:half], tries, wait) + with_retry(embed, texts[half:], tries, wait)


def embed_chunks(
    chunks: DataFrame, make: Callable[[], Embedder], batch: int = 16, tries: int = 5, wait: float = 5.0, concurrency: int = 4
) -> DataFrame:
    """chunks with an `embedding` column, null where the text could not be embedded; text is the only input.

    Each task keeps up to `concurrency` batches in flight, each thread with an embedder of its own, and takes the answers
    in order; a batch that fails is tried again and halved by itself, so it holds up no other.
    """
    at = chunks.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = threading.local()

        def call(texts: list[str]) -> list[list[float] | None]:
            if not hasattr(own, "embed"):
                own.embed = make()
            return with_retry(own.embed, texts, tries, wait)

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for rows in batches:
                texts = rows.column(at).to_pylist()
                answers = pool.map(call, (texts[k : k + batch] for k in range(0, len(texts), batch)))
                vectors = [v for answer in answers for v in answer]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], [*rows.schema.names, "embedding"])

    return chunks.mapInArrow(run, chunks.withColumn("embedding", F.lit(None).cast("array<float>")).schema)


def split_failed(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector, and the sources that have rows without one: those are ingested again next time."""
    return embedded.filter(F.col("embedding").isNotNull()), embedded.filter(F.col("embedding").isNull()).select("source").distinct()

"""What streams did, kept in the store: one small record for each batch, and one for the end of a query."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.store import ChunkStore


class ProgressLog(StreamingQueryListener):
    """Writes each batch's figures into the store. A record is named by run and batch, so it is written once however often
    it is told; nothing is read and no job is started, so the stream does not wait for it."""

    def __init__(self, store: ChunkStore) -> None:
        self.store = store

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.store.append_progress(f"{event.runId}-begin", {
            "event": "begin", "query": event.name, "query_id": str(event.id), "run_id": str(event.runId), "timestamp": event.timestamp,
        })

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.store.append_progress(f"{p.runId}-{p.batchId:012d}", {
            "event": "batch", "query": p.name, "query_id": str(p.id), "run_id": str(p.runId), "timestamp": p.timestamp, "batch_id": p.batchId,
            "input_rows": p.numInputRows, "milliseconds": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
            "observed": {name: {k: str(v) for k, v in row.asDict().items()} for name, row in p.observedMetrics.items()},
        })

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.store.append_progress(f"{event.runId}-end", {
            "event": "end", "query_id": str(event.id), "run_id": str(event.runId), "error": event.exception,
        })


@contextmanager
def recorded(spark: SparkSession, folder: str) -> Iterator[ChunkStore]:
    """Every stream of the session that runs inside is recorded in the store of a folder."""
    store = ChunkStore(spark, folder)
    log = ProgressLog(store)
    spark.streams.addListener(log)
    try:
        yield store
    finally:
        spark.streams.removeListener(log)

"""Best-fit packing of token pieces into fixed-length sequences, by matching of large items.

Packing is planned on the histogram of piece lengths, which has at most `capacity` entries however many
documents there are; the plan is a list of runs ("the items of length s with ranks a..b go, q to a sequence,
into sequences c.. at offset o") whose size depends on the capacity alone, so it may be broadcast. Large
pieces, above a third of the capacity, can only meet in pairs: the longest takes the longest partner that
still fits, at most two a sequence. The other pieces, longest first, go where the least room is left. Ranks
come from counts per (length, bucket) and a numbering inside each bucket, so no length, however common, is
numbered by one task.

Nulls and edge cases: a null or empty text is one piece holding the closing id alone; rows with a null id are
packed like any other; repeated rows are packed as often as they occur (which of them gets which place is
settled by their bytes' checksum, or is immaterial); an empty table gives no pieces. Only the id and text
columns are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import frugal, stash, table
from .encoder import encoder, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for a first one that may be shorter."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, (starts[k + 1] if k + 1 < len(starts) else n) - s) for k, s in enumerate(starts)]


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, room: int) -> DataFrame:
    """One row per piece, with the checksum of its ids."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, room)
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                    ids += tail
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), PIECES)


@dataclass(frozen=True)
class Run:
    """Items of one length with ranks first..first+count-1: per_bin to a sequence, from sequence bin, at offset."""

    length: int
    first: int
    count: int
    per_bin: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place every item of the histogram {length: count}."""
    left = {s: n for s, n in histogram.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: ranges of sequences (first, count)
    bins = 0

    def place(s: int, n: int, per_bin: int, first_bin: int, offset: int) -> None:
        runs.append(Run(s, used[s], n, per_bin, first_bin, offset))
        used[s] += n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    waiting = {s: left[s] for s in large}
    for s in large:
        while n := waiting[s]:
            fits = [t for t in large if t <= capacity - s and waiting[t] - (t == s) > 0]
            t = fits[0] if fits else 0
            pairs = (n // 2 if t == s else min(n, waiting[t])) if t else n
            place(s, pairs, 1, bins, 0)
            waiting[s] -= pairs
            if t:
                place(t, pairs, 1, bins, s)
                waiting[t] -= pairs
            if capacity - s - t:
                gaps[capacity - s - t].append((bins, pairs))
            bins += pairs
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            room = min((g for g in gaps if g >= s and gaps[g]), default=0)
            if room:
                first, count = gaps[room].pop()
            else:
                room, first, count = capacity, bins, -(-n // (capacity // s))
                bins += count
            per_bin = room // s
            full = min(count, n // per_bin)
            if full:
                place(s, full * per_bin, per_bin, first, capacity - room)
                gaps[room - per_bin * s].append((first, full))
            n -= full * per_bin
            rest = count - full
            if rest and n:  # fewer items than one sequence takes: they end in the next one
                place(s, n, n, first + full, capacity - room)
                gaps[room - n * s].append((first + full, 1))
                n, rest, full = 0, rest - 1, full + 1
            if rest:
                gaps[room].append((first + full, rest))
    return runs


def _placer(runs: list[Run]):
    """Arrow function that adds sequence_id and offset to rows with length and rank."""
    order = sorted(runs, key=lambda r: (r.length, r.first))
    keys = np.array([r.length << 48 | r.first for r in order], dtype=np.int64)
    first, per, start, offset, size = (
        np.array([getattr(r, f) for r in order], dtype=np.int64) for f in ("first", "per_bin", "bin", "offset", "length")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            k = rank - first[at]
            columns = batch.columns[:5] + [pa.array(start[at] + k // per[at]), pa.array(offset[at] + k % per[at] * size[at])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    vocabulary: str | None = None,
    end_id: int = 0,
    buckets: int | None = None,
    room: int = 200_000,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece. room: see encoder."""
    spark = docs.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stash(pieces(docs, capacity, vocabulary or vocabulary_path(), end_id, room), "pack-pieces")
    filed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = stash(filed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = filed.withColumn("k", F.row_number().over(inside)).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInArrow(_placer(plan(histogram, capacity)), PIECES + ", sequence_id long, offset long")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

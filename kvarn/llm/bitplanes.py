"""Binary token-id files: fixed-size blocks of ids, transposed into bit or byte planes, compressed by zstandard.

A file holds, in this order: the magic, one zstandard frame per plane of every block (a plane of zeros only is
left out), the document table (ids, null flags and token counts, compressed), the chunk index (for each block
its offset and the length of each plane) and a fixed-size footer that locates both. All integers are
little-endian. A reader takes the footer and the index first and then only the blocks it needs.

Documents are dealt out by ranges of their id, each task writes its range in ascending order to a file of its
own under a temporary name and moves it into place, so a repeated or lost task leaves the same file; the
manifest, written last, lists the files in order with the number of the first id in each. Ranges are cut by the
id and a hash of the text, so one id (or no id) on many rows is no single task.

Nulls and edge cases: a null or empty text is a document of the end id alone; rows with a null id come first;
repeated rows and ties of the id are written as often as they occur, ordered by a hash of the text and the text;
an empty table gives an empty manifest. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import frugal, scratch, stash, table
from .encoder import encoder, vocabulary_path

MAGIC = b"KVBP0001"
_FOOTER = struct.Struct("<QQQQIIB7x8s")  # documents, ids, document table at, index at, block, index crc32, planes, magic
BLOCK_IDS = 65_536
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
MANIFEST = "shard int, part int, path string, n_docs long, n_ids long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI as the executors see it, and the path in it."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parsed.path
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """4 byte planes or 32 bit planes of unsigned 32-bit ids; plane 0 is the least significant."""
    octets = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [octets[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """Inverse of to_planes for n ids; an empty part stands for a plane of zeros."""
    if len(parts) == 4:
        octets = np.zeros((n, 4), dtype=np.uint8)
        for k, part in enumerate(parts):
            if part:
                octets[:, k] = np.frombuffer(part, dtype=np.uint8)
        return octets.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), dtype=np.uint8)
    for k, part in enumerate(parts):
        if part:
            bits[:, k] = np.unpackbits(np.frombuffer(part, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one file, holding one block of ids at a time."""

    def __init__(self, sink, planes: int = 4, block: int = BLOCK_IDS, level: int = 3) -> None:
        self.sink, self.planes, self.block = sink, planes, block
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.held, self.index, self.docs, self.lengths, self.n_ids = bytearray(), [], [], [], 0
        self.at = self._put(MAGIC)

    def _put(self, data: bytes) -> int:
        self.sink.write(data)
        self.at = getattr(self, "at", 0) + len(data)
        return self.at

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held += ids
        while len(self.held) >= 4 * self.block:
            self._flush(4 * self.block)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.held[:size]), dtype="<u4")
        del self.held[:size]
        entry = [self.at]
        for plane in to_planes(ids, self.planes):
            data = self.press(plane) if plane.strip(b"\0") else b""
            self._put(data)
            entry.append(len(data))
        self.index.append(entry)

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        docs_at = self.at
        nulls = np.array([d is None for d in self.docs], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.docs], dtype="<i8")
        self._put(self.press(ids.tobytes() + np.array(self.lengths, dtype="<i8").tobytes() + nulls.tobytes()))
        index_at, index = self.at, np.array(self.index, dtype="<i8").tobytes()
        self._put(index)
        crc = zlib.crc32(index)
        self._put(_FOOTER.pack(len(self.docs), self.n_ids, docs_at, index_at, self.block, crc, self.planes, MAGIC))


@dataclass
class Reader:
    """Reads one file by its chunk index; `source` is a seekable file."""

    source: object

    def __post_init__(self) -> None:
        self.source.seek(0, 2)
        end = self.source.tell() - _FOOTER.size
        self.n_docs, self.n_ids, docs_at, index_at, self.block, crc, self.planes, magic = _FOOTER.unpack(self._get(end, _FOOTER.size))
        index = self._get(index_at, end - index_at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a token file, or a damaged one")
        self.index = np.frombuffer(index, dtype="<i8").reshape(-1, self.planes + 1)
        self.unpress = zstandard.ZstdDecompressor().decompress
        docs = self.unpress(self._get(docs_at, index_at - docs_at)) if self.n_docs else b""
        n = self.n_docs
        self.lengths = np.frombuffer(docs, dtype="<i8", offset=8 * n, count=n) if n else np.zeros(0, dtype=np.int64)
        ids, nulls = np.frombuffer(docs[: 8 * n], dtype="<i8"), docs[16 * n :]
        self.docs = [None if null else int(d) for d, null in zip(ids, nulls)]

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def chunk(self, k: int) -> np.ndarray:
        """The ids of block k."""
        at, sizes = int(self.index[k, 0]), self.index[k, 1:].tolist()
        data, parts, pos = self._get(at, sum(sizes)), [], 0
        for size in sizes:
            parts.append(self.unpress(data[pos : pos + size]) if size else b"")
            pos += size
        return from_planes(parts, min(self.block, self.n_ids - k * self.block))

    def ids(self, first: int, count: int) -> np.ndarray:
        """count ids from number first on, reading only the blocks that hold them."""
        if not count:
            return np.zeros(0, dtype="<u4")
        whole = np.concatenate([self.chunk(k) for k in range(first // self.block, (first + count - 1) // self.block + 1)])
        return whole[first % self.block :][:count]

    def checksums(self) -> Iterator[int]:
        """crc32 of each document's ids as bytes, reading block after block once."""
        k, held = 0, memoryview(b"")
        for length in (4 * self.lengths).tolist():
            crc = 0
            while length:
                if not held:
                    held = memoryview(self.chunk(k).tobytes())
                    k += 1
                crc = zlib.crc32(held[:length], crc)
                length, held = length - len(held[:length]), held[length:]
            yield crc


def write(
    docs: DataFrame,
    folder: str,
    end_id: int = 2,
    planes: int = 4,
    block: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
    vocabulary: str | None = None,
    shards: int | None = None,
) -> DataFrame:
    """Write all documents in ascending order of doc_id; returns the manifest with each file's first id number."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, part, writer = encoder(vocabulary), TaskContext.get().partitionId(), 0, None
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)

        def close() -> pa.RecordBatch:
            writer.close()
            writer.sink.close()
            name = f"ids-{shard:06d}-{part:04d}.kvbp"
            if fs.get_file_info(f"{base}/{name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{name}")
            fs.move(temporary, f"{base}/{name}")
            row = ([shard], [part], [name], [len(writer.docs)], [writer.n_ids])
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(row, types)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "part", "path", "n_docs", "n_ids"])

        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                    if writer is None:
                        temporary = f"{base}/.{uuid4().hex}.tmp"
                        writer = Writer(fs.open_output_stream(temporary), planes, block)
                    writer.add(doc_id, ids + tail)
                    if writer.n_ids >= file_ids or len(writer.docs) >= FILE_DOCS:
                        yield close()
                        writer, part = None, part + 1
        if writer is not None:
            yield close()

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = stash(ordered.select("doc_id", "text").mapInArrow(frugal(run), MANIFEST), "planes-files")
    rows, first = [], 0
    for row in sorted(files.collect(), key=lambda r: (r["shard"], r["part"])):  # one row a file
        rows.append({**row.asDict(), "first_id": first})
        first += row["n_ids"]
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/.manifest.tmp") as sink:
        sink.write(json.dumps({"end_id": end_id, "n_ids": first, "files": rows}).encode())
    fs.move(f"{base}/.manifest.tmp", f"{base}/manifest.json")
    return spark.createDataFrame([(r["path"], r["first_id"]) for r in rows], "path string, first_id long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a folder."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as source:
        manifest = json.loads(source.read())["files"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(k, r["path"], r["first_id"]) for k, r in enumerate(manifest)], "k int, path string, first_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for path, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with fs.open_input_file(f"{base}/{path}") as source:
                    reader = Reader(source)
                    starts = first + np.cumsum(reader.lengths) - reader.lengths
                    crcs = np.fromiter(reader.checksums(), dtype=np.int64, count=reader.n_docs)
                    columns = [pa.array(reader.docs, pa.int64()), pa.array(starts), pa.array(reader.lengths), pa.array(crcs)]
                    for part in pa.table(columns, ["doc_id", "start", "n_tokens", "ids_crc32"]).to_batches(10_000):
                        yield part

    return files.repartitionByRange(len(manifest), "k").mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-planes")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)

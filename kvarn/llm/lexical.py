"""Ranked lexical search, document at a time over compressed postings.

Every task of the scan cuts its documents into shards of bounded text, sorts each shard by doc_id and writes one row
for each term: gaps between the places of its documents and occurrences as variable-length bytes. One further row, of
the empty term, holds the shard's ids and lengths. That table is the index; texts are never shuffled. A search reads
what the items' terms need: document frequencies are summed over shards, and a shard's postings meet the items of a
block in one cell. There each item's posting lists are merged by a heap of their next documents; the sum of a document
goes into a heap of the best k by (score, doc_id). Lists whose greatest parts together can't lift a document over the
k-th score leave the merge heap and are only probed for documents that the others bring, which skips most of the lists
of frequent words and no result. The cells' best rows are merged per item.

All arithmetic is in 64-bit integers: per term the weight w = floor(1000 ln((2N + 2) / (2 df + 1))), per document
m = 25 + (75 n N) div L, and the score sums w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included.

Nulls and edge cases: null texts, and texts without a term, are in no shard and count for nothing; null doc_ids rank
after all others at equal scores; rows that share an id are documents of their own; an item without terms, or a null
one, finds nothing; repeated items are ranked each by itself; empty tables give an empty result. Only doc_id, item_id
and text are read, so further columns may have any name.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import discard, frugal, small_side, stash, table

INDEX = "shard long, term binary, df long, total long, postings binary, ids binary"
FOUND = "item_row long, item_id long, doc_id long, score long"
#: ASCII letters and digits are kept, A-Z in lower case; all other ASCII bytes separate terms; other bytes belong to terms.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(FOLD).split()


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low ones first, the top bit on all but the last; and the number of bytes of each."""
    size = np.ones(len(numbers), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += numbers >> bits > 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        at = (ends - size)[here] + k
        out[at] = (numbers[here] >> (7 * k) & 127) | ((size[here] > k + 1) << 7)
    return out, size


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of pack()."""
    raw = np.frombuffer(packed, dtype=np.uint8)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, dtype=np.int64)
    number = np.cumsum(last) - last
    place = np.arange(len(raw)) - starts[number] if len(raw) else starts
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(raw) else np.zeros(0, dtype=np.int64)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of one buffer as an Arrow column."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


class ShardBuilder:
    """Collects the documents of one shard as numbers: each term once, sixteen bytes for each document that holds it."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.which, self.tf, self.counts, self.ids, self.size = array("q"), array("q"), array("q"), [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        """A document without terms leaves nothing behind."""
        counts, known = Counter(terms(text)), self.known
        if counts:
            self.which.extend([known.setdefault(t, len(known)) for t in counts])
            self.tf.extend(counts.values())
            self.counts.append(len(counts))
            self.ids.append(doc_id)
            self.size += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The index rows of a small shard in one batch."""
        return pa.Table.from_batches(self.batches(shard)).combine_chunks().to_batches()[0]

    def batches(self, shard: int, most: int = 8192) -> Iterator[pa.RecordBatch]:
        """The index rows of the shard, at most so many a batch, its documents in order of their ids, those without id last.

        The builder is used up: beside its numbers stand one sort key and one order for each posting, and all else is made
        for one batch at a time.
        """
        words, n = sorted(self.known), len(self.ids)
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))] = np.arange(len(words))
        self.known = {}
        order = np.array(sorted(range(n), key=lambda d: (self.ids[d] is None, self.ids[d] or 0)), dtype=np.int64)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        ids = np.array([self.ids[d] for d in order.tolist() if self.ids[d] is not None], dtype="<i8")
        tf = np.frombuffer(self.tf, dtype=np.int64)
        key, counts = rank[np.frombuffer(self.which, dtype=np.int64)], np.frombuffer(self.counts, dtype=np.int64)
        self.which = array("q")
        df = np.bincount(key, minlength=len(words))
        key <<= 32
        starts = np.cumsum(counts) - counts
        lengths = np.add.reduceat(tf, starts)[order]
        for d in range(n):
            key[starts[d] : starts[d] + counts[d]] |= place[d]
        by = np.argsort(key)  # no two postings have the same term and document
        head, head_size = pack(lengths)
        yield self._batch(shard, [b""], np.array([n]), lengths.sum(keepdims=True), _binary(head, head_size.sum(keepdims=True)), [ids.tobytes()])
        ends = np.cumsum(df)
        for k in range(0, len(words), most):
            size = df[k : k + most]
            mine = by[ends[k] - df[k] : ends[min(k + most, len(words)) - 1]]
            first = np.cumsum(size) - size
            doc, occurs = key[mine] & 0xFFFFFFFF, tf[mine]
            gaps = np.diff(doc, prepend=0)
            gaps[first] = doc[first]
            data, width = pack(np.stack([gaps, occurs], axis=1).reshape(-1))
            lists = _binary(data, np.add.reduceat(width, 2 * first))
            yield self._batch(shard, words[k : k + most], size, np.add.reduceat(occurs, first), lists, [None] * len(size))

    @staticmethod
    def _batch(shard: int, words: list[bytes], df: np.ndarray, total: np.ndarray, lists: pa.Array, ids: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array([shard] * len(words), pa.int64()), pa.array(words, pa.binary()), pa.array(df), pa.array(total), lists, pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build(docs: DataFrame, shard_bytes: int = 32 << 20, tag: str = "postings", done: list[str] | None = None) -> DataFrame:
    """The index of docs(doc_id, text), written to the shared folder; a shard holds the texts of at most about shard_bytes."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = ShardBuilder(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if shard.ids and shard.size + text.as_buffer().size > shard_bytes:
                    yield from shard.batches(number)
                    shard, number = ShardBuilder(), number + 1
                shard.add(doc_id.as_py(), text.as_py())
        if shard.ids:
            yield from shard.batches(number)

    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    return stash(texts.mapInArrow(run, INDEX), tag, done)


def weight_parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a document, before the term's weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Shard:
    """One shard's lengths and the posting lists that a block of items needs."""

    def __init__(self, ids: bytes, lengths: bytes, documents: int, tokens: int, lists: dict[bytes, tuple[int, bytes]]) -> None:
        self.ids = np.frombuffer(ids, dtype="<i8").tolist()
        n = unpack(lengths)
        self.ids += [None] * (len(n) - len(self.ids))
        m = 25 + (75 * n * documents) // max(tokens, 1)
        names = list(lists)
        flat = unpack(b"".join(lists[t][1] for t in names))
        ends = np.cumsum([lists[t][0] for t in names], dtype=np.int64)
        self.lists: dict[bytes, tuple[list[int], list[int], int]] = {}
        for name, end in zip(names, ends.tolist()):
            own = flat[2 * (end - lists[name][0]) : 2 * end]
            places = np.cumsum(own[::2])
            parts = weight_parts(own[1::2], m[places])
            self.lists[name] = (places.tolist(), parts.tolist(), int(parts.max()))

    def best(self, query: list[tuple[bytes, int]], k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best documents above zero; query: terms with their weights, repeats multiplied in."""
        lists = sorted(((*self.lists[t], w) for t, w in query if w > 0 and t in self.lists), key=lambda x: x[2] * x[3])
        n = len(lists)
        places, parts, weights = [x[0] for x in lists], [x[1] for x in lists], [x[3] for x in lists]
        most = [0]
        for x in lists:
            most.append(most[-1] + x[2] * x[3])
        at, free, bar = [0] * n, 0, 0  # lists before `free` can't reach the bar by themselves
        heap = [places[j][0] * n + j for j in range(n)]
        heapq.heapify(heap)
        top: list[tuple[int, int]] = []
        while heap:
            doc = heap[0] // n
            end, score = (doc + 1) * n, 0
            while heap and heap[0] < end:
                j = heap[0] - doc * n
                score += weights[j] * parts[j][at[j]]
                at[j] += 1
                if at[j] < len(places[j]):
                    heapq.heapreplace(heap, places[j][at[j]] * n + j)
                else:
                    heapq.heappop(heap)
            for j in range(free - 1, -1, -1):
                if score + most[j + 1] <= bar:
                    break
                at[j] = bisect_left(places[j], doc, at[j])
                if at[j] < len(places[j]) and places[j][at[j]] == doc:
                    score += weights[j] * parts[j][at[j]]
            if score <= bar:
                continue
            if len(top) < k:
                heapq.heappush(top, (score, -doc))
            else:
                heapq.heapreplace(top, (score, -doc))
            if len(top) == k and top[0][0] > bar:
                bar = top[0][0]
                was = free
                while free < n and most[free + 1] <= bar:
                    free += 1
                if free > was:
                    heap = [x for x in heap if x % n >= free]
                    heapq.heapify(heap)
        return [(score, -place) for score, place in top]


def _items(items: DataFrame, done: list[str]) -> DataFrame:
    """(item_row, item_id, term, repeats): the terms of every item, numbered by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (row, item, term, n)
                for row, item, text in zip(batch["item_row"].to_pylist(), batch["item_id"].to_pylist(), batch["text"].to_pylist())
                for term, n in Counter(terms(text)).items()
            ]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item_row", "item_id", "term", "repeats"])

    numbered = items.filter(F.col("text").isNotNull()).select(
        F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long"), F.encode("text", "UTF-8").alias("text")
    )
    return stash(numbered.mapInArrow(run, "item_row long, item_id long, term binary, repeats long"), "lexical-items", done)


def search(index: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 65_536, spread: int = 64) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each row of items(item_id, text).

    Items are searched in blocks of about block_terms terms. Every shard gets each block once; blocks travel by broadcast
    while all of them together hold at most 2^20 terms, and else by a join whose keys are dealt `spread` times.
    """
    spark, done = index.sparkSession, []
    asked = _items(items, done)
    heads = index.filter(F.length("term") == 0)
    size = heads.agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    total = asked.count()
    if not size.n or not total:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    documents, tokens, blocks = size.n, size.l, -(-total // block_terms)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_row"), F.lit(blocks)).cast("int"))
    words = stash(asked.select("term", "block").distinct(), "lexical-terms", done)
    pairs = words.count()
    every = small_side(words.select("term").distinct(), pairs, 1 << 18)
    df = index.select("term", "df").join(every, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0 * documents + 2)) / (2 * F.col("df") + 1)))
    weighed = asked.join(small_side(df, pairs, 1 << 18), "term")
    lists = weighed.groupBy("block", "item_row", "item_id").agg(F.collect_list(F.struct("term", (weight * F.col("repeats")).alias("w"))).alias("query"))
    packed = stash(lists.groupBy("block").agg(F.collect_list(F.struct("item_row", "item_id", "query")).alias("items")), "lexical-blocks", done)
    per_block = heads.select("shard", "term", "df", "postings", "ids", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    if total <= 1 << 20:
        with_items = per_block.join(F.broadcast(packed), "block")
    else:
        dealt = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        with_items = per_block.withColumn("salt", F.pmod("shard", F.lit(spread)).cast("int")).join(dealt, ["block", "salt"]).drop("salt")
    needed = index.select("shard", "term", "df", "postings").join(small_side(words, pairs, 1 << 18), "term")
    cells = needed.unionByName(with_items, allowMissingColumns=True)

    def cell(group: pa.Table) -> pa.Table:
        rows = group.select(["term", "df", "postings"]).to_pylist()
        head = next((i for i, r in enumerate(rows) if not r["term"]), None)
        found = []
        if head is not None:
            lists = {r["term"]: (r["df"], r["postings"]) for r in rows if r["term"]}
            shard = Shard(group["ids"][head].as_py(), rows[head]["postings"], documents, tokens, lists)
            for item in group["items"][head].as_py():
                best = shard.best([(q["term"], q["w"]) for q in item["query"]], k)
                found += [(item["item_row"], item["item_id"], shard.ids[place], score) for score, place in best]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    found = stash(cells.groupBy("shard", "block").applyInArrow(cell, FOUND), "lexical-found")  # k rows for each shard and item
    discard(spark, done)
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"), done=(written := []))
    found = search(index, table(spark, sf_dir, "benchmark"))
    discard(spark, written)
    return found


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS tokens FROM t WHERE len(terms) > 0
), p AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM t) GROUP BY r, term
), q AS (
  SELECT i, item_id, term, count(*) AS repeats
  FROM (SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL))
  GROUP BY i, item_id, term
), f AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s
), x AS (
  SELECT q.i, q.item_id, t.doc_id, p.r,
         sum(q.repeats * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * len(t.terms) * s.docs) // s.tokens))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN t ON t.r = p.r, s
  GROUP BY q.i, q.item_id, t.doc_id, p.r
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

"""Benchmark decontamination by latent semantic retrieval and longest common subsequences.

1. Document frequencies of hashed terms (2 ** bits buckets) are counted over all documents.
2. A randomised SVD of TF-IDF passages gives the latent space. Its vocabulary are the terms of the benchmark items and
   those terms of the corpus that weigh most, `vocabulary` in all (more if the items alone have more); other terms have
   no latent vector but count in the length of a window. The matrix holds every benchmark item (weighted) and all
   passages of all documents, which together weigh at most as much as those of `sample_docs` documents, lest a large
   corpus drown the items. Its range is found by one distributed product A'(A X) with a sparse random X, summed by
   blocks of terms, and kept whole; only factors of fixed size reach the driver.
3. Windows of several lengths slide over every document. A window that cannot reach the threshold is dropped by
   bounds on sums (the most each term can add to any item's product, then to any of eight); the others are projected and
   compared with all items by cosine.
4. Candidates are checked on the words: the longest common subsequence of item and surrounding text, and for
   looser matches (paraphrases) whether the item's answer, its most informative words, is there too.

Items are taken in blocks of `block_items`, and `pass_blocks` blocks are searched in one pass over the documents, so
neither the latent space nor what travels with a task grows with the benchmark.

Items under `least_words` words are too short for windows: matches() reports them where their words stand in a row
(kind "exact"), and clean() keeps such documents, as so few words prove no leak. Nulls and edge cases: null or empty
texts and items without words match nothing; repeated rows of one document id count as one document whose best match
is kept; rows with a null id are left out of the result of matches(); an empty table on either side gives an empty
result. Texts are searched whole. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import frugal, stash, table

_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    """Lower-case words set off by blanks; everything of Basic Latin but letters and digits separates them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED)


def words_of(text: str | None) -> list[bytes]:
    """The words of a plain text."""
    return plain(text).split()


@dataclass(frozen=True)
class Params:
    bits: int = 20
    vocabulary: int = 16_384
    sample_docs: int = 2000
    passage: int = 48
    weight: float = 4.0
    cosine: float = 0.45
    leak: float = 0.8
    paraphrase: float = 0.5
    answer: float = 0.8
    least_words: int = 6
    block_items: int = 256
    pass_blocks: int = 4
    seed: int = 11


def _hashed(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of plain texts, and how many words each text and those before it have.

    Words are read eight bytes at a time, all words at once; no word holds a zero byte, so no two read alike. What goes
    beyond 64 bytes (scripts without blanks) counts by its checksum.
    """
    joined = b" " + b" ".join(texts) + b" " * 9
    blank = np.frombuffer(joined, dtype=np.uint8) == 32
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, length = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))
    h = eight[start] & _KEEP[np.minimum(length, 8)]
    h *= _ODD
    h ^= h >> np.uint64(32)
    for k in range(8, 72, 8):
        longer = np.flatnonzero(length > k) if k == 8 else longer[length[longer] > k]
        if k < 64:
            more = eight[start[longer] + k] & _KEEP[np.minimum(length[longer] - k, 8)]
        else:
            rests = zip((start[longer] + k).tolist(), (start[longer] + length[longer]).tolist())
            more = np.array([crc32(joined[begin:end]) for begin, end in rests], dtype=np.uint64)
        more = (h[longer] + more) * _ODD
        h[longer] = more ^ (more >> np.uint64(32))
    ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    return ((h * _ODD) >> np.uint64(64 - bits)).astype(np.int64), ends


def buckets(words: list[bytes], bits: int) -> np.ndarray:
    return _hashed(words, bits)[0]


def slabs(texts: pa.Array, bits: int, room: int = 1 << 18) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """All texts, plain, about room bytes at a time, with the buckets of their words and where each text's words end."""
    held, total = [], 0
    for text in texts:
        held.append(plain(text.as_py()))
        total += len(held[-1]) + 1
        if total >= room:
            yield held, *_hashed(held, bits)
            held, total = [], 0
    if held:
        yield held, *_hashed(held, bits)


def _summed(rows: DataFrame, part: str) -> DataFrame:
    """Sums of the parts (bytes of numbers of the type) with the same k, whole numbers as longs."""
    kind = "k int, part binary"
    wide = np.int64 if np.dtype(part).kind == "i" else np.dtype(part).type

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(one.as_buffer(), dtype=part)
                if k in sums:
                    sums[k] += more
                else:
                    sums[k] = more.astype(wide)
        for k, total in sums.items():
            yield _part(k, total)

    return rows.repartition("k").mapInArrow(frugal(fold), kind)


def _part(k: int, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["k", "part"])


def frequencies(docs: DataFrame, p: Params) -> tuple[np.ndarray, int]:
    """Document frequency of every bucket, and the number of documents; tasks and driver handle them in slices of fixed size."""
    step = 1 << max(0, p.bits - 6)
    many = 1 << p.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(many + 1, dtype=np.int32)  # the last entry counts documents
        last = np.zeros(many, dtype=np.int64)  # the place at which a document's bucket stands last
        for batch in batches:
            count[-1] += batch.num_rows
            for _, at, ends in slabs(batch.column(0), p.bits):
                place = np.arange(len(at))
                for begin, end in zip([0, *ends.tolist()], ends.tolist()):
                    own, here = at[begin:end], place[begin:end]
                    last[own] = here
                    count[own[last[own] == here]] += 1
        for k in range(0, many + 1, step):
            if count[k : k + step].any():
                yield _part(k // step, count[k : k + step])

    df = np.zeros(many + step, dtype=np.int64)
    for row in _summed(docs.select("text").mapInArrow(frugal(run), "k int, part binary"), "<i4").collect():  # at most 65 slices
        part = np.frombuffer(row["part"], dtype="<i8")
        df[row["k"] * step : row["k"] * step + len(part)] = part
    return df[:many], int(df[many])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies: smooth, never nothing, whatever the share of documents that hold a term."""
    return (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)


def slots(items: list[np.ndarray], df: np.ndarray, idf: np.ndarray, p: Params) -> np.ndarray:
    """Row of the latent space of every bucket: the items' buckets and the corpus's heaviest; the last row for all others."""
    own = np.unique(np.concatenate(items))
    mass = df * idf
    mass[own] = 0
    more = min(max(0, p.vocabulary - len(own)), int(np.count_nonzero(mass)))
    heavy = np.argpartition(-mass, more)[:more] if more < len(mass) else np.arange(len(mass))
    chosen = np.sort(np.concatenate([own, heavy]))
    out = np.full(len(df), len(chosen), dtype=np.int32)
    out[chosen] = np.arange(len(chosen))
    return out


def _product(at: np.ndarray, ends: np.ndarray, factor: float, idf: np.ndarray, x: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Adds A'(A x) to out, for the matrix whose rows are tf-idf passages of unit length, times the factor.

    at holds the passages' words as rows of out, other numbers from len(out) on, and ends where each passage ends; x is
    sparse, some places and signs for every row. Rows of frequent terms are summed by one matrix product, the others by
    small ones, together for all terms of as many passages.
    """
    size, width, n = len(out), out.shape[1], len(ends)
    key = (np.repeat(np.arange(n) * size, np.diff(ends, prepend=0)) + at)[at < size]
    key, tf = np.unique(key.astype(np.int32) if n * size < 1 << 31 else key, return_counts=True)
    passage = key // size
    term = key - passage * size
    v = tf * idf[term]
    v *= factor / np.sqrt(np.bincount(passage, v * v, n))[passage]
    column, sign = x
    z, first = np.zeros(n * width), passage.astype(np.int64) * width
    for k in range(column.shape[1]):
        z += np.bincount(first + column[:, k][term], v * sign[:, k][term], n * width)
    z, v = z.reshape(n, width).astype(np.float32), v.astype(np.float32)
    order = np.argsort(term.astype(np.uint16) if size <= 1 << 16 else term, kind="stable")
    passage, term, v = passage[order], term[order], v[order]
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    count = np.diff(begin, append=len(term))
    few = max(8, n // 32)
    often = np.flatnonzero(count > few)
    own = np.repeat(np.where(count > few, np.cumsum(count > few) - 1, -1), count)
    dense = np.zeros((len(often), n), dtype=np.float32)
    dense[own[own >= 0], passage[own >= 0]] = v[own >= 0]
    out[term[begin[often]]] += dense @ z
    for c in np.unique(count[count <= few]).tolist():
        same = begin[count == c]
        for k in range(0, len(same), max(1, 256 // c)):  # what lies between fits a processor's cache
            some = same[k : k + max(1, 256 // c)]
            these = some[:, None] + np.arange(c)
            out[term[some]] += np.matmul(v[these][:, None], z[passage[these]])[:, 0]


def latent_space(docs: DataFrame, n: int, items: list[np.ndarray], slot: np.ndarray, idf: np.ndarray, p: Params) -> np.ndarray:
    """Term vectors of the latent space, vocabulary x rank, orthonormal columns, fitted on the items and all n documents."""
    spark, size = docs.sparkSession, int(slot.max())
    width = min(len(items) + 40, size)
    own_idf = idf[np.flatnonzero(slot < size)]
    step = -(-size // 64)
    rng = np.random.default_rng(p.seed)
    x = rng.integers(0, width, (size, 4)), rng.choice(np.array([-1.0, 1.0]), (size, 4))
    balance = float(np.sqrt(min(1.0, p.sample_docs / max(n, 1))))
    shared = spark.sparkContext.broadcast((x, own_idf, slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, weight, where = shared.value
        out = np.zeros((size, width), dtype=np.float32)
        for batch in batches:
            for _, at, ends in slabs(batch.column(0), p.bits, 1 << 19):
                at, begin = where[at], np.r_[0, ends[:-1]]
                pieces = -(-(ends - begin) // p.passage)
                first = np.cumsum(pieces) - pieces
                cuts = np.repeat(begin - first * p.passage, pieces) + np.arange(1, pieces.sum() + 1) * p.passage
                cuts = np.minimum(cuts, np.repeat(ends, pieces))
                for k in range(0, len(cuts), 2048):
                    some, start = cuts[k : k + 2048], cuts[k - 1] if k else 0
                    _product(at[start : some[-1]], some - start, balance, weight, x, out)
        for k in range(0, size, step):
            yield _part(k // step, out[k : k + step])

    out = np.zeros((size, width), dtype=np.float32)
    at = [slot[i] for i in items]
    _product(np.concatenate(at), np.cumsum([len(i) for i in at]), p.weight, own_idf, x, out)
    summed = _summed(docs.select("text").mapInArrow(frugal(run), "k int, part binary"), "<f4")
    for row in summed.collect():  # the factor: vocabulary x rank, whatever the corpus
        part = np.frombuffer(row["part"], dtype=np.float32).reshape(-1, width)
        out[row["k"] * step : row["k"] * step + len(part)] += part
    shared.unpersist()
    return np.linalg.qr(out)[0].astype(np.float32)


def common_subsequence(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[bytes, int] = {}
    for k, word in enumerate(item):
        at[word] = at.get(word, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for word in text:
        hit = row & at.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _row_sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For every column of rows the sum of those rows of the table."""
    total = table[rows[0]]
    for row in rows[1:]:
        total += table[row]
    return total


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    answer: list[bytes]


class Searcher:
    """Searches texts for the items of one block."""

    def __init__(self, items: list[Item], space: np.ndarray, slot: np.ndarray, idf: np.ndarray, p: Params) -> None:
        self.items, self.slot, self.p = items, slot, p
        self.rank = space.shape[1]
        self.space = np.concatenate([space * idf[np.flatnonzero(slot < len(space))][:, None], np.zeros((1, self.rank), dtype=np.float32)])
        vectors, own = [], [buckets(item.words, p.bits) for item in items]
        for at in own:
            terms, tf = np.unique(at, return_counts=True)
            norm = float(np.sqrt(((tf * idf[terms]) ** 2).sum())) or 1.0
            vectors.append((tf[:, None] * self.space[slot[terms]]).sum(axis=0) / norm)
        self.vectors = np.array(vectors, dtype=np.float32)
        share = (self.vectors**2).sum(axis=1)  # what the latent space keeps of an item
        self.vectors /= np.maximum(share, 1e-3)[:, None]
        products = self.space @ self.vectors.T
        self.reach = products.max(axis=1)  # the most a term adds to any product
        self.group_reach = np.maximum.reduceat(products, np.arange(0, len(items), 8), axis=1)  # and to those of eight items
        sizes = [len(i.words) for i in items]
        self.lengths = np.array(sizes)
        self.own, self.own_first = slot[np.concatenate(own)], np.cumsum(sizes) - self.lengths
        low, high = min(sizes), max(sizes)
        # the smallest is half an item, so that one of its steps lies wholly inside a copy, whatever stands around it
        self.windows = sorted({max(p.least_words, w) for w in (low // 2, low, *(int(low * 2**k) for k in range(1, high.bit_length() + 1))) if w <= high})

    def candidates(self, at: np.ndarray, ends: np.ndarray, energy: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(text, [(item, place, cosine)]) of the texts of a slab with near windows; energy sums the words' squared weights."""
        p, null, begin = self.p, len(self.space) - 1, np.r_[0, ends[:-1]]
        reach = np.r_[0, np.cumsum(self.reach[at], dtype=np.float64)]
        near_by: list[tuple[np.ndarray, ...]] = []
        for size in self.windows:
            half = max(1, size // 2)
            many = np.where(ends - begin < p.least_words, 0, -(-np.maximum(1, ends - begin - size // 2) // half))
            starts = np.repeat(begin - (np.cumsum(many) - many) * half, many) + np.arange(many.sum()) * half
            stops = np.minimum(starts + size, np.repeat(ends, many))
            norm = np.sqrt(np.maximum(energy[stops] - energy[starts], 1e-9))
            able = reach[stops] - reach[starts] >= (p.cosine - 1e-4) * norm
            starts, stops, norm = starts[able], stops[able], norm[able]
            most = max(16, min(1024, (1 << 18) // size))
            for slab in range(0, len(starts), most):
                first, stop, length = starts[slab : slab + most], stops[slab : slab + most], norm[slab : slab + most]
                place = first + np.arange(size)[:, None]  # the k-th word of every window is a row
                terms = np.where(place < stop, at[np.minimum(place, len(at) - 1)], null)  # no vector, no reach
                near = _row_sums(self.group_reach, terms).max(axis=1) >= (p.cosine - 1e-4) * length
                if not near.any():
                    continue
                first = first[near]
                cosines = _row_sums(self.space, terms[:, near]) @ self.vectors.T / length[near, None]
                w, k = np.nonzero(cosines >= p.cosine)
                text = np.searchsorted(ends, first, side="right")[w]
                near_by.append((text, k, (first[w] - begin[text]) // self.lengths[k], cosines[w, k]))
        if not near_by:
            return
        text, k, where, cosine = map(np.concatenate, zip(*near_by))
        order = np.lexsort((-cosine, where, k, text))
        text, k, where, cosine = text[order], k[order], where[order], cosine[order]
        best = np.r_[True, (text[1:] != text[:-1]) | (k[1:] != k[:-1]) | (where[1:] != where[:-1])][: len(text)]
        text, k, where, cosine = text[best], k[best], where[best], cosine[best]
        cuts = np.flatnonzero(np.diff(text, prepend=-1)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(text)]):
            t = int(text[low])
            held = np.zeros(null + 1, dtype=bool)
            held[at[begin[t] : ends[t]]] = True
            there = np.add.reduceat(held[self.own], self.own_first, dtype=np.int64) >= min(p.paraphrase, p.leak) * self.lengths
            some = np.flatnonzero(there[k[low:high]]) + low  # the others' words are not there, wherever
            if len(some):
                yield t, list(zip(k[some].tolist(), where[some].tolist(), cosine[some].tolist()))

    def search(self, texts: list[bytes], at: np.ndarray, ends: np.ndarray, energy: np.ndarray) -> Iterator[tuple[int, int, float, float, str]]:
        """(text, item_id, cosine, share of the item found in order, kind) of every item in the texts of a slab."""
        p = self.p
        for t, places in self.candidates(self.slot[at], ends, energy):
            words = texts[t].split()
            found: dict[int, tuple[float, float, str]] = {}
            whole, there_at_all = set(words), {}
            for k, where, cosine in places:
                item = self.items[k]
                n = len(item.words)
                if k not in there_at_all:
                    there_at_all[k] = sum(map(whole.__contains__, item.words))
                if there_at_all[k] < min(p.paraphrase, p.leak) * n:
                    continue
                region = words[max(0, (where - 1) * n) : (where + 3) * n]
                there = set(region)
                answered = sum(map(there.__contains__, item.answer)) >= p.answer * len(item.answer)
                if sum(map(there.__contains__, item.words)) < (p.paraphrase if answered else p.leak) * n:
                    continue  # no common subsequence can be longer than the words that are there at all
                share = common_subsequence(item.words, region) / n
                kind = "leak" if share >= p.leak else "paraphrase" if answered and share >= p.paraphrase else ""
                if kind and (share, cosine) > found.get(item.item_id, (0.0, 0.0, ""))[:2]:
                    found[item.item_id] = (share, cosine, kind)
            for item_id, (share, cosine, kind) in found.items():
                yield t, item_id, cosine, share, kind


class Index:
    """What one pass looks for: some blocks of items by windows, and short items word by word."""

    def __init__(self, searchers: list[Searcher], short: list[Item], idf: np.ndarray | None, p: Params) -> None:
        self.searchers, self.p = searchers, p
        self.energy = None if idf is None else idf.astype(np.float64) ** 2
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item in short:
            self.short.setdefault(len(item.words), {}).setdefault(tuple(item.words), []).append(item.item_id)

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, str]]:
        """(row, item_id, cosine, share, kind) of every item in the texts of a column."""
        row = 0
        for texts, at, ends in slabs(column, self.p.bits):
            if self.searchers:
                energy = np.r_[0, np.cumsum(self.energy[at])]
                for searcher in self.searchers:
                    for t, *hit in searcher.search(texts, at, ends, energy):
                        yield row + t, *hit
            for t, text in enumerate(texts if self.short else []):
                words = text.split()
                for n, known in self.short.items():
                    for grams in known.keys() & set(zip(*(words[k:] for k in range(n)))):
                        yield from ((row + t, i, 1.0, 1.0, "exact") for i in known[grams])
            row += len(texts)


def prepared(docs: DataFrame, benchmark: DataFrame, p: Params, with_short: bool) -> Iterator:
    """For each pass its index, of bounded size whatever corpus and benchmark, as a broadcast."""
    usable = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    blocks = max(1, -(-usable.count() // p.block_items))
    numbered = stash(usable.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "leak-items")
    df = idf = None
    for first in range(0, blocks, p.pass_blocks):
        searchers, short = [], []
        for block in range(first, min(blocks, first + p.pass_blocks)):
            rows = sorted((r["item_id"], words_of(r["text"])) for r in numbered.filter(F.col("block") == block).collect())
            short += [Item(i, w, []) for i, w in rows if 0 < len(w) < p.least_words]
            rows = [(i, w) for i, w in rows if len(w) >= p.least_words]
            if not rows:
                continue
            if idf is None:
                df, n = frequencies(docs, p)
                idf = weights(df, n)
            items = []
            for item_id, words in rows:
                by_weight = sorted(set(words), key=lambda w: (-float(idf[buckets([w], p.bits)[0]]), w))
                items.append(Item(item_id, words, by_weight[: max(3, len(by_weight) // 4)]))
            at = [buckets(i.words, p.bits) for i in items]
            slot = slots(at, df, idf, p)
            searchers.append(Searcher(items, latent_space(docs, n, at, slot, idf, p), slot, idf, p))
        if searchers or (short and with_short):
            index = Index(searchers, short if with_short else [], idf, p)
            del searchers
            yield docs.sparkSession.sparkContext.broadcast(index)


def matches(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, cosine, share, kind): the items that each document holds."""
    schema = "doc_id long, item_id long, cosine double, share double, kind string"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in prepared(texts, benchmark, p, True):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = [(batch.column(0)[row].as_py(), *hit) for row, *hit in index.search(batch.column(1))]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*hits) if hits else [[]] * 5, types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "share", "kind"])

        out = out.unionByName(texts.filter("doc_id is not null").mapInArrow(frugal(run), schema))
    best = F.max(F.struct("share", "cosine", "kind")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.cosine", "b.share", "b.kind")


def clean(docs: DataFrame, benchmark: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the rows that hold a benchmark item of least_words words or more; all columns stay, nothing is shuffled."""
    at, out = docs.columns.index("text"), docs
    for shared in prepared(docs.select("doc_id", "text"), benchmark, p, False):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[row for row, *_ in index.search(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(frugal(run), docs.schema)
    return out


def op1(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

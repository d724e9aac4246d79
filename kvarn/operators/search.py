"""Retrieval: dense nearest neighbours, Okapi BM25, reciprocal rank fusion, concept and dependents search.

Chunks are rows (collection, sid, text, ...); all operators rank within a collection first. Rank windows have a row
limit, which Spark turns into partial limits before the shuffle, so no collection is sorted whole by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.routing import candidate_cap
from ..session import stash

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to a query vector."""
    target = F.array(*[F.lit(float(x)) for x in query])
    gaps = F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def ranked(rows: DataFrame, by: list[Column], most: int, name: str) -> DataFrame:
    """The first `most` rows of each collection, with their rank from 1."""
    order = Window.partitionBy("collection").orderBy(*by)
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= most)


def dense(chunks: DataFrame, query: list[float], most: int, vector: str = "embedding") -> DataFrame:
    """Per collection the nearest chunks: distance and dense_rank."""
    scored = chunks.filter(F.col(vector).isNotNull()).withColumn("distance", F.round(squared_distance(F.col(vector), query), 6))
    return ranked(scored, [F.col("distance"), F.col("sid")], most, "dense_rank")


class Bm25Index:
    """An inverted file in blocks, document lengths and term weights; build once, keep as tables, query many times.

    The documents of a collection are dealt into ranges of some hundred documents of similar length. A block holds the
    entries (sid, tf, length) of one term in one range, with the greatest factor that any of them gives the term's weight.
    """

    def __init__(self, blocks: DataFrame, lengths: DataFrame, terms: DataFrame) -> None:
        self.blocks, self.lengths, self.terms = blocks, lengths, terms

    @classmethod
    def build(cls, chunks: DataFrame, unique: bool = True, range_rows: int = 256) -> Bm25Index:
        """One pass over the texts counts terms by (collection, sid, term), with a row of the empty term for each document; the rest reads that.

        Chunks of one collection and sid count once: with unique=False their first text in order is taken, otherwise the
        caller (a store keyed by chunk id) vouches that there are none.
        """
        if not unique:
            chunks = chunks.groupBy("collection", "sid").agg(F.min("text").alias("text"))
        tokens = chunks.select("collection", "sid", tokenize(F.col("text")).alias("tokens"))
        words = tokens.select("collection", "sid", F.size("tokens").alias("length"), F.explode(F.array_append("tokens", F.lit(""))).alias("term"))
        counted = stash(words.groupBy("collection", "sid", "length", "term").agg(F.count("*").alias("tf")), "bm25")
        lengths = counted.filter("term = ''").select("collection", "sid", "length")
        entries = counted.filter("term <> ''")
        corpus = fixed(lengths.groupBy("collection").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length")))  # a row for each collection
        df = entries.groupBy("collection", "term").agg(F.count("*").alias("df"))  # combined before its shuffle
        raw = df.join(F.broadcast(corpus), "collection").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        floor = raw.groupBy("collection").agg((F.avg("idf") * EPSILON).alias("floor"))
        terms = raw.join(F.broadcast(floor), "collection").select(
            "collection", "term", "df", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf")
        )
        octave = F.floor(2 * F.log2(F.col("length") + 1)).cast("long")  # documents of similar length share ranges
        spread = F.greatest(F.lit(1), F.floor(F.col("n") / (8 * range_rows))).cast("long")
        placed = entries.join(F.broadcast(corpus), "collection").withColumn("range", octave * (1 << 32) + F.pmod(F.xxhash64("sid"), spread))
        out = cls(_blocks(placed), lengths, terms)
        out._placed = placed
        return out

    _placed: DataFrame | None = None  # the entries of an index that is not saved, by range

    @property
    def postings(self) -> DataFrame:
        """(collection, sid, term, tf) of every term of every document."""
        entries = self._placed if self._placed is not None else self.blocks.select("collection", "term", F.inline("entries"))
        return entries.select("collection", "sid", "term", "tf")

    def _some(self, words: Column) -> DataFrame:
        """The blocks of some terms; where they are not saved, only those are put together."""
        return _blocks(self._placed.filter(words)) if self._placed is not None else self.blocks.filter(words)

    def save(self, path: str) -> None:
        """Write the index: blocks and terms lie in order of their term, so a query reads the row groups of its own."""
        self.blocks.repartitionByRange("term", "collection", "range").sortWithinPartitions("term", "collection", "range").write.mode("overwrite").parquet(f"{path}/blocks")
        self.lengths.repartitionByRange("collection", "sid").sortWithinPartitions("collection", "sid").write.mode("overwrite").parquet(f"{path}/lengths")
        self.terms.repartitionByRange("term", "collection").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "lengths", "terms")))

    def only(self, keep: Column) -> Bm25Index:
        """The index of some collections; figures of a collection do not depend on the others."""
        out = Bm25Index(self.blocks.filter(keep), self.lengths.filter(keep), self.terms.filter(keep))
        out._placed = None if self._placed is None else self._placed.filter(keep)
        return out

    def _weighed(self, wanted: Counter) -> DataFrame:
        """The blocks of the wanted terms with weight = idf times the repeats in the query."""
        table = F.create_map(*[F.lit(x) for w, n in wanted.items() for x in (w, float(n))])
        words = F.col("term").isin(*wanted)
        weights = self.terms.filter(words).select("collection", "term", (F.col("idf") * F.element_at(table, F.col("term"))).alias("weight"))
        weights = fixed(weights)  # a row for each word and collection
        found = self._some(words).join(F.broadcast(weights), ["collection", "term"])
        return found if self._placed is None else stash(found, "bm25-words")  # a search reads its blocks several times

    @staticmethod
    def _summed(blocks: DataFrame) -> DataFrame:
        """(collection, sid, bm25) of the documents that weighed blocks hold."""
        hits = blocks.select("collection", "weight", "mean_length", F.inline("entries"))
        part = F.col("weight") * gain(F.col("tf"), F.col("length"), F.col("mean_length"))
        return hits.groupBy("collection", "sid").agg(F.round(F.sum(part), 6).alias("bm25"))

    def scores(self, query: str) -> DataFrame:
        """BM25 of every document, zero included: (collection, sid, bm25). Repeated query words count repeatedly."""
        wanted = Counter(query.lower().split())
        every = self.lengths.select("collection", "sid")
        if not wanted:
            return every.withColumn("bm25", F.lit(0.0)).limit(0)
        summed = self._summed(self._weighed(wanted))
        return every.join(summed, ["collection", "sid"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))

    def search(self, query: str, most: int, keep: DataFrame | None = None) -> DataFrame:
        """Per collection the best documents with bm25_rank; zero scores stay, ties by sid. keep(sid) filters first.

        A range's bound is the sum of its blocks' greatest parts. The `most` ranges of highest bound are scored first; the
        score that their documents reach at place `most` is passed by no document of a range with a lower bound, so only
        the others are read. Documents without any hit are looked up where fewer than `most` have a score above zero.
        """
        wanted = Counter(query.lower().split())
        if not wanted:
            return self.scores(query).withColumn("bm25_rank", F.lit(0)).limit(0)
        blocks = self._weighed(wanted)
        kept = lambda rows: rows if keep is None else rows.join(keep.select("sid"), "sid", "left_semi")
        heads = blocks.groupBy("collection", "range").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"))
        first = ranked(heads, [F.desc("bound"), F.col("range")], most, "place").select("collection", "range")
        trial = kept(self._summed(blocks.join(F.broadcast(first), ["collection", "range"], "left_semi")))
        bars = ranked(trial, [F.desc("bm25"), F.col("sid")], most, "place").filter((F.col("place") == most) & (F.col("bm25") > 0))
        bar = {r.collection: r.bm25 for r in bars.select("collection", "bm25").collect()}  # a number for each collection
        if bar:
            least = F.try_element_at(F.create_map(*[F.lit(x) for pair in bar.items() for x in pair]), F.col("collection"))
            open_ranges = heads.filter(F.col("bound") + 1e-6 >= F.coalesce(least, F.lit(float("-inf")))).select("collection", "range")
            blocks = blocks.join(open_ranges, ["collection", "range"], "left_semi")
        scored = kept(self._summed(blocks))
        poor = self.lengths.filter(~F.coalesce(F.col("collection").isin(*bar), F.lit(False))) if bar else self.lengths
        if not bar or not poor.isEmpty():
            rest = kept(poor.select("collection", "sid")).join(scored, ["collection", "sid"], "left_anti").withColumn("bm25", F.lit(0.0))
            scored = scored.unionByName(ranked(rest, [F.col("sid")], most, "place").drop("place"))
        return ranked(scored, [F.desc("bm25"), F.col("sid")], most, "bm25_rank")


def _blocks(placed: DataFrame) -> DataFrame:
    """Entries by collection, term and range, with the greatest gain of each block."""
    return placed.groupBy("collection", "term", "range").agg(
        F.max(gain(F.col("tf"), F.col("length"), F.col("mean_length"))).alias("top"), F.max("mean_length").alias("mean_length"),
        F.count("*").alias("n"), F.collect_list(F.struct("sid", "tf", "length")).alias("entries"),
    )


def fixed(rows: DataFrame) -> DataFrame:
    """A table of bounded size, worked out once and kept as literal rows."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def gain(tf: Column, length: Column, mean_length: Column) -> Column:
    """What an occurrence count multiplies a term's weight by."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


class VectorIndex:
    """Exact nearest neighbours from few cells: vectors filed under centroids, with their distance to it.

    By the triangle inequality no vector of a cell is nearer to a query than the query's distance to the centroid less the
    vector's own. Cells are partition folders, their rows lie in order of that distance, and a search reads the cells and
    distances that can hold one of the best; it never leaves one out. Centroids come from a bounded sample and decide only
    how much is read. Vectors that are null, or of another length than the query, take no part.
    """

    MARGIN = 1e-5

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path
        self.rows, self.cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, cells: int = 256, sample_rows: int = 8192, vector: str = "embedding") -> VectorIndex:
        """Write an index of chunks(collection, sid, vector): centroids by k-means over at most sample_rows vectors of each length."""
        spark = chunks.sparkSession
        rows = chunks.filter(F.col(vector).isNotNull()).select("collection", "sid", F.col(vector).alias("embedding"))
        centers: dict[int, np.ndarray] = {}
        for size in [r[0] for r in rows.select(F.size("embedding")).distinct().collect()]:  # a collection has one length
            drawn = rows.filter(F.size("embedding") == size).orderBy(F.xxhash64("sid"), "sid").limit(sample_rows).select("embedding").collect()
            centers[size] = _centroids(np.array([r[0] for r in drawn], dtype=np.float64).reshape(len(drawn), size), cells)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch["embedding"].to_pylist()
                cell, gap = np.zeros(len(given), dtype=np.int32), np.zeros(len(given))
                for size, middle in centers.items():
                    mine = [k for k, v in enumerate(given) if len(v) == size]
                    x = np.array([given[k] for k in mine], dtype=np.float64).reshape(len(mine), size)
                    cell[mine] = np.argmin((middle**2).sum(axis=1) - 2 * x @ middle.T, axis=1) if len(mine) else 0
                    gap[mine] = np.sqrt(((x - middle[cell[mine]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], [*batch.schema.names, "cell", "gap"])

        kind = rows.schema["sid"].dataType.simpleString()
        schema = f"collection string, sid {kind}, embedding array<{rows.schema['embedding'].dataType.elementType.simpleString()}>, cell int, gap double"
        filed = stash(rows.mapInArrow(file, schema).withColumn("size", F.size("embedding")), "cells")
        spaced = filed.repartitionByRange("collection", "size", "cell", "gap").sortWithinPartitions("collection", "size", "cell", "gap")
        spaced.write.partitionBy("collection", "size", "cell").mode("overwrite").parquet(f"{path}/rows")
        table = spark.createDataFrame([(s, c, v.tolist()) for s, m in centers.items() for c, v in enumerate(m)], "size int, cell int, centroid array<double>")
        seen = filed.groupBy("collection", "size", "cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"))
        seen.join(F.broadcast(table), ["size", "cell"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def search(self, query: list[float], most: int, keep: Column | None = None, among: DataFrame | None = None) -> DataFrame:
        """(collection, sid, distance, dense_rank) of the nearest per collection; keep chooses collections, among(sid) rows.

        The cells nearest to the query that hold `most` rows give a distance that the best don't exceed; then every cell
        that its bounds let in is read, and of it the rows whose own distance to the centroid lets them in.
        """
        q = np.array(query, dtype=np.float64)
        table = self.cells.filter(F.col("size") == len(q))
        known = (table if keep is None else table.filter(keep)).collect()  # cells of each collection: the index's own size
        gaps = {r.cell: float(np.linalg.norm(q - np.array(r.centroid))) for r in known}
        by_collection: dict[str, list[Row]] = {}
        for r in sorted(known, key=lambda r: gaps[r.cell]):
            by_collection.setdefault(r.collection, []).append(r)
        first: list[tuple] = []
        for name, cells in by_collection.items():
            taken = 0
            for r in cells:
                if taken < most:
                    first.append((name, r.cell, None))
                    taken += r.n
        trial = self._read(first, query, among)
        bars = ranked(trial, [F.col("distance"), F.col("sid")], most, "place").filter(F.col("place") == most)
        bar = {r.collection: float(np.sqrt(r.distance)) + self.MARGIN for r in bars.select("collection", "distance").collect()}
        wanted = []
        for name, cells in by_collection.items():
            reach = bar.get(name, float("inf"))
            for r in cells:
                if max(gaps[r.cell] - r.high, r.low - gaps[r.cell]) <= reach:
                    wanted.append((name, r.cell, (gaps[r.cell] - reach, gaps[r.cell] + reach)))
        self.read_cells = wanted
        return ranked(self._read(wanted, query, among), [F.col("distance"), F.col("sid")], most, "dense_rank")

    def candidates(self, wanted: list[tuple], size: int) -> DataFrame:
        """Rows of some (collection, cell, (least, greatest) distance to the centroid)."""
        bounds = self.spark.createDataFrame(
            [(c, cell, *(b or (float("-inf"), float("inf")))) for c, cell, b in wanted], "in_collection string, in_cell int, least double, most double"
        )
        rows = self.rows.filter((F.col("size") == size) & F.col("cell").isin(sorted({w[1] for w in wanted})) & F.col("collection").isin(sorted({w[0] for w in wanted})))
        same = (F.col("collection") == F.col("in_collection")) & (F.col("cell") == F.col("in_cell")) & F.col("gap").between(F.col("least"), F.col("most"))
        return rows.join(F.broadcast(bounds), same, "left_semi")  # as many rows as cells

    def _read(self, wanted: list[tuple], query: list[float], among: DataFrame | None) -> DataFrame:
        rows = self.candidates(wanted, len(query))
        rows = rows if among is None else rows.join(among.select("sid"), "sid", "left_semi")
        return rows.select("collection", "sid", F.round(squared_distance(F.col("embedding"), query), 6).alias("distance"))


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample by k-means, started at rows far from each other."""
    if len(sample) <= 1:
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, max(1, int(np.sqrt(len(sample)) * 2))) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    middle = sample[chosen].copy()
    for _ in range(rounds):
        own = np.argmin((middle**2).sum(axis=1) - 2 * sample @ middle.T, axis=1)
        for c in np.unique(own):
            middle[c] = sample[own == c].mean(axis=0)
    return middle


def fuse(lists: list[tuple[DataFrame, str]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (ranked rows, rank column): (collection, sid, rrf)."""
    parts = [df.select("collection", "sid", (1.0 / (k + F.col(rank))).alias("part")) for df, rank in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("collection", "sid").agg(F.round(F.sum("part"), 9).alias("rrf"))


def hybrid(
    chunks: DataFrame, index: Bm25Index, query: str, vector: list[float], k: int, cap: object = None, keep: DataFrame | None = None, near: DataFrame | None = None
) -> DataFrame:
    """The k best chunks over all collections by fused dense and BM25 ranks, which are taken per collection.

    keep(sid) limits what is ranked, not what the term weights are counted over. near has the dense ranks where an index
    has found them; otherwise all vectors of chunks are measured.
    """
    most = candidate_cap(k, cap)
    near = (dense(chunks, vector, most) if near is None else near).select("collection", "sid", "dense_rank")
    sparse = index.search(query, most, keep).select("collection", "sid", "bm25_rank")
    both = near.join(sparse, ["collection", "sid"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 9))
    last = F.lit(2**31 - 1)
    order = [F.desc("rrf"), F.col("collection"), F.coalesce("bm25_rank", last), F.coalesce("dense_rank", last), F.col("sid")]
    return scored.orderBy(*order).limit(k)


def dense_multi(chunks: DataFrame, vector: list[float], k: int) -> DataFrame:
    """Top k per collection, merged by distance, first k."""
    return dense(chunks, vector, max(1, k)).orderBy("distance", "collection", "sid").limit(k)


def by_concept(chunks: DataFrame, concept: str, most: int = 80) -> DataFrame:
    """Chunks tagged with a concept id, without case, up to `most` per collection."""
    wanted = concept.strip().replace("|", "").lower()
    tagged = chunks.filter(F.exists("concepts", lambda c: F.lower(c) == wanted))
    return ranked(tagged, [F.col("sid")], most, "position")


def stems(hits: DataFrame) -> DataFrame:
    """Sorted distinct file stems and chunk names of hits(relative_path, chunk_name)."""
    stem = F.regexp_extract(F.coalesce("relative_path", F.lit("")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    both = F.filter(F.array(stem, F.trim(F.coalesce("chunk_name", F.lit("")))), lambda s: s != "")
    return hits.select(F.explode(both).alias("stem")).distinct().orderBy("stem")


def dependents(chunks: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """Chunks whose dependencies hold one of names(stem): exploded and joined on equality, never compared pairwise.

    At most `most` (20 at most) of each collection are looked at, and as many are returned.
    """
    limit = max(1, min(20, most))
    needs = chunks.select("collection", "sid", F.explode(F.split("dependencies", ", ")).alias("stem"))
    found = needs.join(names, "stem", "left_semi").select("collection", "sid").distinct()
    few = ranked(found, [F.col("sid")], limit, "position").orderBy("collection", "sid").limit(limit).select("collection", "sid")
    return chunks.join(F.broadcast(few), ["collection", "sid"], "left_semi")  # a handful of rows

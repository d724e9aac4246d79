"""Exact top-k by inner product over a bit-sliced index.

Vectors are turned to integers and dealt into blocks of rows. The index stores, for each block, the leading bits of
every attribute as bitmaps over its rows (bit slices) with the exact values beside them. For a query the slices are
added with bitmap arithmetic only: every signed digit of the rounded query adds shifted slices (complements for
negative digits) into carry-save adders, which gives the slices of the approximate score. The best rows are then
selected from the most significant score slice downward. Two rounding bounds (Cauchy-Schwarz on what the query and
the index left out) give the band around the k-th score in which the order is open; all rows of that boundary are
resolved by exact integer products. Blocks of rows meet blocks of queries in a grid of bounded cells, and the
cells' best rows are merged per query. Vectors of each length are a space of their own, searched in turn.

Values whose products could leave 64 bits are kept apart in their block, and such queries too: those products are
made one by one with unbounded integers. Scores beyond the range of a long are shown as its end, ranked exactly
within their block.

Nulls and edge cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do vectors
with a null id; vectors without components score 0; ties go to the smaller id; a query leaves out the rows of its
own id, repeated ids are rows of their own among candidates and queries of their own; fewer candidates than k give
fewer rows; an empty table gives an empty result. Only the id and vector columns are read, so further columns may
have any name.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .base import stash, table

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "query_id long, query_row long, vec_id long, score long"
TILE = "ids binary, rows binary, v binary, slices binary, depth int, shift int, low binary, norm double, rest double, far_ids binary, far binary"
LONG = (-(1 << 63), (1 << 63) - 1)


def _bitmaps(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 flags as rows of 64-bit words."""
    pad = -bits.shape[1] % 64
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")
    return packed.view(np.uint64)


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(position, sign) of the non-adjacent form."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3) if value > 0 else -(2 - (-value & 3))
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


def add_slices(levels: dict[int, list[np.ndarray]], words: int) -> np.ndarray:
    """Sum of bitmaps weighted by powers of two: slices of the sum, least significant first."""
    out, level = [], 0
    while levels:
        stack = levels.pop(level, None)
        x = np.concatenate(stack) if stack else np.zeros((0, words), dtype=np.uint64)
        carries = []
        while len(x) >= 3:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * m :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        if carries:
            levels.setdefault(level + 1, []).extend(carries)
        out.append(x[0] if len(x) else np.zeros(words, dtype=np.uint64))
        level += 1
    return np.array(out) if out else np.zeros((1, words), dtype=np.uint64)


def kth_largest(slices: np.ndarray, valid: np.ndarray, k: int) -> int:
    """The k-th largest sum among the valid rows, from the most significant slice downward."""
    greater, equal, value = 0, valid, 0
    for at in range(len(slices) - 1, -1, -1):
        upper = equal & slices[at]
        n = int(np.bitwise_count(upper).sum())
        if greater + n >= k:
            equal, value = upper, value | 1 << at
        else:
            greater, equal = greater + n, equal & ~slices[at]
    return value


def at_least(slices: np.ndarray, valid: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the valid rows whose sum is bound or more."""
    if bound <= 0:
        return valid
    if bound >> len(slices):
        return valid & ~valid
    over, equal = valid & ~valid, valid
    for at in range(len(slices) - 1, -1, -1):
        if bound >> at & 1:
            equal = equal & slices[at]
        else:
            over = over | (equal & slices[at])
            equal = equal & ~slices[at]
    return over | equal


def whole(vector: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, exact however large."""
    return [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in vector]


def _limit(dims: int) -> float:
    """Components below it have scores within 62 bits."""
    return 2.0 ** (30 - dims.bit_length() / 2)


@dataclass
class Block:
    """One block of rows: ids in ascending order, exact integers, and the bit slices of those that fit 64-bit products."""

    ids: np.ndarray
    values: np.ndarray
    kept_bits: int = 6
    scale: int = 1

    def __post_init__(self) -> None:
        order = np.argsort(self.ids, kind="stable")
        ids, given = self.ids[order], self.values[order].astype(np.float64)
        with np.errstate(over="ignore"):
            values = np.floor(given * self.scale)
        fits = (np.abs(values) < _limit(given.shape[1])).all(axis=1)
        self.far_ids, self.far = ids[~fits], given[~fits]
        self.ids, self.values = ids[fits], values[fits].astype(np.int64)
        n = len(self.ids)
        self.low = self.values.min(axis=0) if n else np.zeros(given.shape[1], dtype=np.int64)
        offsets = self.values - self.low
        self.shift = max(0, int(offsets.max(initial=0)).bit_length() - self.kept_bits)
        lead = offsets >> self.shift
        self.depth = max(1, int(lead.max(initial=0)).bit_length())
        flags = (lead.T[:, None, :] >> np.arange(self.depth)[None, :, None] & 1).astype(np.uint8)
        self.slices = _bitmaps(flags.reshape(given.shape[1] * self.depth, n))
        self.norm = float(np.sqrt((self.values.astype(float) ** 2).sum(axis=1)).max(initial=0))
        rest = self.values - (lead << self.shift) - (self.low + ((1 << self.shift) - 1) / 2)
        self.rest = float(np.sqrt((rest**2).sum(axis=1)).max(initial=0))
        self._derive()

    def _derive(self) -> None:
        top = int(np.abs(self.values).max(initial=0))
        self.exact = self.values.astype(np.float64 if top * top * self.values.shape[1] < 1 << 52 else np.int64)
        self.all = _bitmaps(np.ones((1, len(self.ids)), dtype=np.uint8))[0]

    def stored(self) -> dict:
        """The block as a row of the index."""
        arrays = {"ids": self.ids, "v": self.values, "slices": self.slices, "low": self.low, "far_ids": self.far_ids, "far": self.far}
        return {k: a.tobytes() for k, a in arrays.items()} | {"depth": self.depth, "shift": self.shift, "norm": self.norm, "rest": self.rest}

    @classmethod
    def loaded(cls, row: dict, scale: int = 1) -> Block:
        out = cls.__new__(cls)
        out.scale = scale
        out.ids, out.low, out.far_ids = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "low", "far_ids"))
        n, dims = len(out.ids), len(out.low)
        out.values = np.frombuffer(row["v"], dtype="<i8").reshape(n, dims)
        out.far = np.frombuffer(row["far"], dtype="<f8").reshape(len(out.far_ids), dims)
        out.depth, out.shift, out.norm, out.rest = row["depth"], row["shift"], row["norm"], row["rest"]
        out.slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(dims * out.depth, -(-n // 64))
        out._derive()
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, exact score) of the k best rows but the query's own, far rows and far queries included."""
        exact, found = whole(query.tolist(), self.scale), []
        dot = lambda v: sum(a * b for a, b in zip(exact, v))
        found += [(i, dot(whole(v, self.scale))) for i, v in zip(self.far_ids.tolist(), self.far.tolist()) if i != query_id]
        if max(map(abs, exact), default=0) >= _limit(len(exact)):
            found += [(i, dot(v)) for i, v in zip(self.ids.tolist(), self.values.tolist()) if i != query_id]
        elif len(self.ids):
            found += zip(*(a.tolist() for a in self.top(query_id, np.array(exact, dtype=np.int64), k)))
        return heapq.nsmallest(k, found, key=lambda f: (-f[1], f[0]))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but the query's own."""
        valid = self.all.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            valid[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        n = int(np.bitwise_count(valid).sum())
        if n > 4 * k:
            shift = max(0, int(np.abs(query).max(initial=0)).bit_length() - 5)
            rounded = (query + (1 << shift >> 1)) >> shift
            rows, flips, where = [], [], []
            for d, value in enumerate(rounded.tolist()):
                for at, sign in signed_digits(value):
                    for b in range(self.depth):
                        rows.append(d * self.depth + b)
                        flips.append(sign < 0)
                        where.append(at + b)
            rows, flips, where = np.array(rows, dtype=int), np.array(flips, dtype=bool), np.array(where, dtype=int)
            levels = {}
            for level in np.unique(where):
                here = where == level
                levels[int(level)] = [self.slices[rows[here]] ^ (FULL * flips[here].astype(np.uint64))[:, None]]
            slices = add_slices(levels, len(valid))
            query_rest = float(np.linalg.norm(query - (rounded << shift)))
            slack = query_rest * self.norm + float(np.linalg.norm(rounded << shift)) * self.rest
            bound = kth_largest(slices, valid, k) - int(2 * slack / (1 << (shift + self.shift))) - 2
            valid = at_least(slices, valid, bound)
        rows = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
        scores = (self.exact[rows] @ query.astype(self.exact.dtype)).astype(np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _numbers(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the whole numbers of a table of vectors of one length."""
    flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return group.column("vec_id").to_numpy(), flat.reshape(group.num_rows, -1) if len(flat) else np.zeros((group.num_rows, 0))


def _tiles(rows: DataFrame, key: str, tiles: int, scale: int | None = None) -> DataFrame:
    """Rows packed into tiles of about equal size, repeated rows included; with a scale as blocks of the index."""
    schema = f"{key} int, {TILE}"
    names = [f.split()[0] for f in schema.split(", ")]

    def pack(group: pa.Table) -> pa.Table:
        ids, values = _numbers(group)
        row = {"ids": ids.astype("<i8").tobytes(), "v": values.astype("<f8").tobytes(), "rows": group.column("row").to_numpy().tobytes()}
        if scale:
            row = Block(ids, values, scale=scale).stored()
        row[key] = group.column(key)[0].as_py()
        types = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
        return pa.table([pa.array([row.get(n)], types[f.split()[1]]) for n, f in zip(names, schema.split(", "))], names)

    dealt = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", "row"), F.lit(tiles)).cast("int"))
    return dealt.groupBy(key).applyInArrow(pack, schema)


def _space(rows: DataFrame, asked: DataFrame, size: Row, k: int, scale: int, block_rows: int, lane_rows: int) -> DataFrame:
    """Best rows of every block for every query among vectors of one length."""
    dims, blocks, lanes = size["dims"], -(-size["n"] // block_rows), -(-size["q"] // lane_rows)
    index = stash(_tiles(rows, "block", blocks, scale), "bsi-index").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    lane = stash(_tiles(asked, "lane", lanes), "bsi-queries")
    lane = lane.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(tile: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if tile.num_rows and queries.num_rows:
            block, given = Block.loaded(tile.to_pylist()[0], scale), queries.to_pylist()[0]
            ids, numbers = (np.frombuffer(given[c], dtype="<i8") for c in ("ids", "rows"))
            for query_id, number, query in zip(ids.tolist(), numbers.tolist(), np.frombuffer(given["v"], dtype="<f8").reshape(len(ids), dims)):
                found += [(query_id, number, i, min(max(s, LONG[0]), LONG[1])) for i, s in block.best(query_id, query, k)]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "query_row", "vec_id", "score"])

    return index.groupBy("block", "lane").cogroup(lane.groupBy("block", "lane")).applyInArrow(cell, RESULT)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    block_rows: int = 16_384,
    lane_rows: int = 4_096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that is_query picks."""
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    v = F.col("embedding").cast("array<double>").alias("v")
    rows = usable.select(F.col("vec_id").cast("long"), v, F.monotonically_increasing_id().alias("row"), is_query.alias("asks"))
    rows = stash(rows, "bsi-rows")  # the numbering of rows is written down before it is used
    sizes = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()  # one row a length
    best = spark.createDataFrame([], RESULT)
    for size in sizes:
        if size["q"]:
            own = rows.filter(F.size("v") == size["dims"])
            best = best.unionByName(_space(own, own.filter("asks"), size, k, scale, block_rows, lane_rows))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

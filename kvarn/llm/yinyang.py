"""Clustering of vectors around centroids by Yinyang k-means, in whole numbers.

Components become floor(scale * x). The starting centroids are clustered into groups once. Every vector keeps its
cluster, an upper bound of its distance to that centroid and one lower bound per group of the distance to the others.
When centroids move, the bounds move by as much, and only what the bounds leave open is looked at: first the least of
all lower bounds (global filter), then each group's, then each centroid's own move (local filter); what survives is
measured exactly. Distances are compared as whole numbers, so ties go to the smaller centroid exactly; bounds have a
margin for rounding and are only ever used to skip what can't win or tie.

Each round writes the vectors with their bounds to the shared folder and drops the round before it. Sums of a cluster
are made per task and added up per component: `k` times the dimensions are all that the driver ever holds, the model
itself. Sums are split into limbs of 40 bits, so they are exact for any finite component and any number of rows.

Nulls and edge cases: a vector that is null, of another length, or holds a null, NaN or infinite component takes no
part; a null vec_id takes part and is chosen as a start last; equal hashes (repeated ids) go by the vector; fewer
vectors than centroids give as many centroids as there are vectors; repeated rows are vectors of their own, also as
starts; an empty cluster keeps its centroid; distances and sums beyond the range of a long are shown as its end,
compared exactly; an empty table gives an empty result. Only vec_id and embedding are read, so further columns may have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, stash, table
from .topk import whole

STATE = "vec_id long, embedding array<double>, cluster int, upper double, lower array<double>"
ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, dim int, limb int, s long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Below it squared distances of 64 components are exact in doubles.
NARROW = 1 << 22
LIMB = 40
MARGIN = 1e-9
LONG_END = (1 << 63) - 1
WIDEST = 1.7e308


def numbers(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of each component: doubles where distances stay exact in them, unbounded integers otherwise."""
    given = np.array(vectors, dtype=np.float64)
    with np.errstate(over="ignore"):
        out = np.floor(given * scale)
    if not out.size or (np.abs(out).max() < NARROW and out.shape[1] <= 64):
        return out
    return np.array([whole(v, scale) for v in vectors], dtype=object)


def matrix(centroids: list[list[int]]) -> np.ndarray:
    top = max((abs(x) for c in centroids for x in c), default=0)
    return np.array(centroids, dtype=np.float64 if top < NARROW and len(centroids[0]) <= 64 else object)


def unbounded(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return x if x.dtype == object else np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, y one row or as many as x."""
    if object in (x.dtype, y.dtype):
        x, y = unbounded(np.atleast_2d(x)), unbounded(np.atleast_2d(y))
    return ((x - y) ** 2).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Distances as doubles; beyond the range of doubles a number near its end, which skips nothing."""
    if squares.dtype != object:
        return np.sqrt(squares)
    wide = lambda v: math.sqrt(v) if v >> 1000 == 0 else float(math.isqrt(v)) if v >> 2046 == 0 else WIDEST
    return np.array([min(wide(int(v)), WIDEST) for v in squares.flat], dtype=np.float64).reshape(squares.shape)


class Model:
    """Centroids, their groups, and how far each has moved since the vectors' bounds were made."""

    def __init__(self, centroids: list[list[int]], group: np.ndarray, before: list[list[int]] | None = None) -> None:
        self.c, self.group, self.groups = matrix(centroids), group, int(group.max()) + 1
        self.drift = np.zeros(len(centroids)) if before is None else roots(squared(matrix(before), self.c)) * (1 + MARGIN)
        self.group_drift = np.array([self.drift[group == g].max() for g in range(self.groups)])
        self.measured = 0

    def squares(self, x: np.ndarray, c: int | np.ndarray) -> np.ndarray:
        """Exact squared distances of rows to one centroid, or to one each."""
        self.measured += len(x)
        return squared(x, self.c[c])

    def _lows(self, bounds: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The least bound per group, the own centroid left out."""
        bounds = bounds.copy()
        bounds[np.arange(len(own)), own] = np.inf
        return np.stack([bounds[:, self.group == g].min(axis=1) for g in range(self.groups)], axis=1)

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper bound and lower bounds of new vectors."""
        d = np.stack([self.squares(x, c) for c in range(len(self.c))], axis=1)
        own = np.argmin(d, axis=1).astype(np.int64)
        far = roots(d)
        return own, far[np.arange(len(own)), own], self._lows(far, own)

    def advance(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after the centroids have moved."""
        own, before = own.copy(), lower
        upper, lower = upper + self.drift[own], before - self.group_drift
        reach = lambda u: u * (1 + MARGIN) + MARGIN
        rows = np.flatnonzero(reach(upper) >= lower.min(axis=1))
        squares = self.squares(x[rows], own[rows])
        upper[rows] = roots(squares)
        still = reach(upper[rows]) >= lower[rows].min(axis=1)
        rows, best = rows[still], squares[still]
        first, winner, near = own[rows], own[rows].copy(), upper[rows].copy()
        bounds = lower[rows][:, self.group]
        bounds[np.arange(len(rows)), first] = near
        for c in range(len(self.c)):
            g = self.group[c]
            own_move = before[rows, g] - self.drift[c]
            other, open_ = first != c, reach(near) >= lower[rows, g]
            scan = np.flatnonzero(other & open_ & (reach(near) >= own_move))
            bounds[:, c] = np.where(other, np.maximum(bounds[:, c], own_move), bounds[:, c])
            if not len(scan):
                continue
            d = self.squares(x[rows[scan]], c)
            bounds[scan, c] = roots(d)
            better = (d < best[scan]) | ((d == best[scan]) & (c < winner[scan]))
            hit = scan[better.astype(bool)]
            best[hit], winner[hit] = d[better.astype(bool)], c
            near[hit] = bounds[hit, c]
        own[rows], upper[rows] = winner, near
        lower[rows] = self._lows(bounds, winner)
        return own, upper, lower


def group_centroids(centroids: list[list[int]], size: int) -> np.ndarray:
    """A group number for each centroid: a few rounds of plain k-means over the centroids themselves, about `size` to a group."""
    x = np.array([[float(v) for v in c] for c in centroids])
    x = x / max(1.0, np.abs(x).max())
    middles = x[: -(-len(x) // size)].copy()
    for _ in range(5):
        group = ((x[:, None] - middles[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            middles[g] = x[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def _pieces(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    """Slices in which rows times centroids stay bounded."""
    step = max(256, (1 << 20) // k)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _floats(rows: list, width: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.asarray(rows, dtype=np.float64).reshape(-1)), width).cast(pa.list_(pa.float64()))


def _assign(vectors: DataFrame, model: Model, scale: int, final: bool) -> DataFrame:
    """One round over all vectors: their new state, or with final their cluster and exact distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _pieces(b, len(model.c))):
            x = numbers(batch["embedding"].to_pylist(), scale)
            if "cluster" in batch.schema.names:
                lower = np.array(batch["lower"].to_pylist(), dtype=np.float64)
                own, upper, lower = model.advance(x, batch["cluster"].to_numpy().astype(np.int64), batch["upper"].to_numpy(), lower)
            else:
                own, upper, lower = model.start(x)
            cluster = pa.array(own.astype(np.int32))
            if final:
                d = pa.array([min(int(v), LONG_END) for v in model.squares(x, own)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], cluster, d], ["vec_id", "cluster", "distance"])
            else:
                columns = [batch["vec_id"], batch["embedding"], cluster, pa.array(upper), _floats(lower, lower.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "cluster", "upper", "lower"])

    return vectors.mapInArrow(run, ASSIGNED if final else STATE)


def _limbs(value: int) -> list[int]:
    """Signed limbs of 40 bits, the last with the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(state: DataFrame, k: int, dims: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """(rows, component sums) of each cluster that has rows; dimension `dims` holds the count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=object)
        for batch in batches:
            x, own = numbers(batch["embedding"].to_pylist(), scale), batch["cluster"].to_numpy()
            for c in np.unique(own):
                mine = x[own == c]
                total[c, :dims] += np.array([int(v) for v in mine.sum(axis=0)], dtype=object)
                total[c, dims] += len(mine)
        rows = [(c, d, j, v) for c in range(k) if total[c, dims] for d in range(dims + 1) for j, v in enumerate(_limbs(int(total[c, d])))]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [*[pa.int32()] * 3, pa.int64()])], ["cluster", "dim", "limb", "s"])

    added = state.select("embedding", "cluster").mapInArrow(partial, SUMS).groupBy("cluster", "dim", "limb").agg(F.sum("s").alias("s"))
    out = [[0] * (dims + 1) for _ in range(k)]
    for r in added.collect():  # the model's size: k rows of dims + 1 numbers
        out[r.cluster][r.dim] += r.s << (LIMB * r.limb)
    return {c: (v[dims], v[:dims]) for c, v in enumerate(out) if v[dims]}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, group_size: int = 4) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding) after some rounds."""
    spark, done = vectors.sparkSession, []
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull()).filter(fine)
    kept = kept.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(drawn.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    centroids = [whole(r.embedding, scale) for r in starts]
    group = group_centroids(centroids, group_size)
    state, model, k = kept, Model(centroids, group), len(centroids)
    for _ in range(rounds):
        old, done = done, []
        state = stash(_assign(state, model, scale, final=False), "yinyang", done)
        discard(spark, old)
        sums = _sums(state, k, dims, scale)
        moved = [[s // sums[c][0] for s in sums[c][1]] if c in sums else centroids[c] for c in range(k)]
        model, centroids = Model(moved, group, centroids), moved
    final = stash(_assign(state, model, scale, final=True), "yinyang-result")
    discard(spark, done)
    capped = lambda c: F.least(c, F.lit(LONG_END).cast("decimal(38,0)")).cast("long")
    exact = F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")
    per = final.groupBy("cluster").agg(exact)
    every = per.agg(capped(F.sum("s")).alias("inertia"))
    texts = spark.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centroids)], "cluster int, numbers string")
    facts = per.join(texts, "cluster").select("cluster", capped(F.col("s")).alias("cluster_inertia"), F.sha2("numbers", 256).alias("centroid_sha256"))
    facts = facts.join(F.broadcast(every))  # one row
    joined = final.join(F.broadcast(facts), "cluster")  # at most k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The same by plain k-means: every vector against every centroid, in each round."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1)::INTEGER AS c, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v.vec_id, any_value(v.q) AS q, min(struct_pack(d := {distance}, c := c.c)) AS m FROM v CROSS JOIN c{r} c GROUP BY v.vec_id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.q, c.q) AS q
  FROM c{r} c LEFT JOIN (
    SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS q
    FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT m.c AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c
  ) n ON n.c = c.c
)""")
    body = ", ".join(steps)
    return f"""
WITH {body}
SELECT a.vec_id, a.m.c AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c
"""


SQL = _sql()

"""Connected components by randomised contraction, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash


def components(edges: DataFrame, tag: str = "cc", done: list[str] | None = None) -> DataFrame | None:
    """Map every node of edges(u, v) to the root of its component: (node, root).

    Each round gives every node a pseudo-random priority, hooks it to the best neighbour (or itself)
    and contracts the links; a constant share of the nodes goes in every round, so a link table of n
    nodes needs about log n rounds whatever its shape. Neighbour minima are partial aggregates, so a
    node with a third of all links costs one row per task; the relabelling joins are plain sort-merge
    joins that adaptive execution can split. Returns None when there is no link. The paths of the tables that the
    result is read from go to the list done.
    """
    current = stash(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct(),
        tag,
        done,
    )
    maps: list[DataFrame] = []
    while not current.isEmpty():
        seed = F.lit(len(maps) + 1)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", seed).alias("p"), F.col("v").alias("n"))).alias("b"))
        own = F.struct(F.xxhash64("u", seed).alias("p"), F.col("u").alias("n"))
        hook = stash(best.select(F.col("u").alias("node"), F.least(F.col("b"), own)["n"].alias("root")), tag, done)
        maps.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = current.join(left, "u").join(right, "v").filter("ru <> rv")
        current = stash(
            moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), tag, done
        )
    if not maps:
        return None
    out = maps.pop()
    while maps:
        upper = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = maps.pop().join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out

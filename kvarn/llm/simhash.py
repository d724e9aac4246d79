"""SimHash near-duplicate classes by a self-join of binary tries.

A signature has `lanes` fingerprints of 64 bits. Two signatures within `budget` differing bits have a lane
within budget // lanes bits, and such a lane agrees wholly on at least `match` of its `parts` blocks of bits.
So every fingerprint is filed under each choice of `match` blocks. The fingerprints of one file form a binary
trie over the remaining bits; node pairs of that trie are walked together from the root, each step down adds
the bits in which the two sides differ, and a pair is dropped as soon as it has spent the lane's budget. A
file with more than `cap` fingerprints is never handed to a task: it is filed again under blocks of its free
bits, until the free bits alone bound its size. The walk is exact: every pair within the budget is met.

Nulls and edge cases: a null or empty text, or one of white space only, has fingerprint zero and links like
any other; equal fingerprints are one node (copies are never expanded to pairs); repeated rows come back as
often as they went in; rows with a null id take part, and a class made of such rows only has a null id.
An empty table gives an empty result. Only the id and text columns are read, so further columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, frugal, small_side, stash, table
from .components import components

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_SLAB = 16_384
_PAIRS = 100_000


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """An independent hash of each hash: lane 0 as it is, others by a 64-bit finaliser."""
    if not lane:
        return hashes
    h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signature(text: str | None, words: int = 3, lanes: int = 1) -> np.ndarray:
    """Majority bits of the XXH64 (seed 42) of all word shingles: one unsigned fingerprint a lane."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(lanes, dtype=np.uint64)
    n = max(1, len(tokens) - words + 1)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)))) if len(tokens) >= words else [b" ".join(tokens)]
    hashes = np.fromiter(map(_HASH, shingles), dtype="<u8", count=n)
    ones = np.zeros(BITS * lanes, dtype=np.int64)
    for at in range(0, n, _SLAB):
        slab = np.stack([_mixed(hashes[at : at + _SLAB], lane) for lane in range(lanes)], axis=1)
        ones += np.unpackbits(slab.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int) -> DataFrame:
    """(doc_id, f0, f1, ...): one row per document, fingerprints as signed longs."""
    names = [f"f{lane}" for lane in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.zeros((batch.num_rows, lanes), dtype=np.uint64)
            for k, text in enumerate(batch.column(1)):
                sigs[k] = signature(text.as_py(), words, lanes)
            columns = [pa.array(np.ascontiguousarray(sigs[:, lane]).view(np.int64)) for lane in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        frugal(run), "doc_id long, " + ", ".join(f"{n} long" for n in names)
    )


@lru_cache(maxsize=None)
def _masks(path: tuple[int, ...], parts: int, match: int) -> tuple[int, ...]:
    """The bit masks that files below path are keyed by; path holds the choice made at each level so far."""
    fixed = _masks(path[:-1], parts, match)[path[-1]] if path else 0
    free = [b for b in range(BITS - 1, -1, -1) if not fixed >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    blocks = [sum(1 << b for b in free[cuts[k] : cuts[k + 1]]) for k in range(parts)]
    return tuple(fixed | sum(chosen) for chosen in combinations(blocks, match))


def _file(frame: DataFrame, parts: int, match: int, lanes: int) -> DataFrame:
    """File each fingerprint under blocks of its free bits: (lane, path, key, node, f0, ...)."""
    names = ["lane", "path", "key", "node", *(f"f{lane}" for lane in range(lanes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lane, path = np.asarray(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for at in {(int(a), b) for a, b in zip(lane, path)}:
                own = batch.filter(pa.array((lane == at[0]) & (path == at[1])))
                fps = np.asarray(own.column(3 + at[0]))
                steps = tuple(map(int, at[1].split(".")[1:]))
                for k, mask in enumerate(_masks(steps, parts, match)):
                    key = fps & np.array([mask], dtype=np.uint64).view(np.int64)[0]
                    child = pa.array([f"{at[1]}.{k}"] * len(fps))
                    yield pa.RecordBatch.from_arrays([own.column(0), child, pa.array(key), *own.columns[2:]], names)

    schema = "lane int, path string, key long, node long, " + ", ".join(f"{n} long" for n in names[4:])
    return frame.select("lane", "path", *names[3:]).mapInArrow(frugal(run), schema)


def trie_links(
    fps: np.ndarray, group: np.ndarray, budget: int, emit: Callable[[np.ndarray, np.ndarray], None]
) -> None:
    """Emit index pairs of fps (unsigned, sorted within each run of equal group) within the budget.

    A trie node is a range of the sorted array. Node pairs of one depth are walked together, at most
    `_PAIRS` at a time; the rest waits on a stack, so memory stays bounded in dense files too.
    """
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edges[:-1], edges[1:]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    stack = [(BITS - 1, np.stack([lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > _PAIRS:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        a_lo, a_hi, b_lo, b_hi, spent = pairs
        done = (a_hi - a_lo) * (b_hi - b_lo) <= (16 if bit >= 0 else 2**62)
        if done.any():  # a few leaves on either side: compare what is left of their paths at once
            la, lb, wa, wb = a_lo[done], b_lo[done], (a_hi - a_lo)[done], (b_hi - b_lo)[done]
            sizes = wa * wb
            pair = np.repeat(np.arange(len(sizes)), sizes)
            k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            i, j = la[pair] + k // wb[pair], lb[pair] + k % wb[pair]
            ok = i < j
            i, j = i[ok], j[ok]
            ok = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            emit(i[ok], j[ok])
            a_lo, a_hi, b_lo, b_hi, spent = pairs[:, ~done]
        if not len(a_lo):
            continue
        ones = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        both = a_lo != b_lo
        walked = np.concatenate(
            [
                np.stack([a_lo, a_mid, b_lo, b_mid, spent]),
                np.stack([a_mid, a_hi, b_mid, b_hi, spent]),
                np.stack([a_lo, a_mid, b_mid, b_hi, spent + 1]),
                np.stack([a_mid, a_hi, b_lo, b_mid, spent + 1])[:, both],
            ],
            axis=1,
        )
        wide = (walked[1] > walked[0]) & (walked[3] > walked[2])
        pays = (walked[4] <= budget) & ((walked[0] != walked[2]) | (walked[1] - walked[0] > 1))
        if (live := wide & pays).any():
            stack.append((bit - 1, walked[:, live]))


class Classes:
    """Smallest index reachable from each of n items, as links come in."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.label[i], self.label[j]
        while (apart := i != j).any():
            i, j = i[apart], j[apart]
            low = np.minimum(i, j)
            np.minimum.at(self.label, i, low)
            np.minimum.at(self.label, j, low)
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up
            i, j = self.label[i], self.label[j]


class Nearest:
    """Pairs to verify of n items: each item's `most` nearest by distance, and what else it takes to span every class."""

    def __init__(self, n: int, most: int = 4) -> None:
        self.classes, self.most = Classes(n), most
        self.rows, self.held, self.forest = [np.zeros((3, 0), dtype=np.int64)], 0, []

    def add(self, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> None:
        self.rows += [np.stack([i, j, distance]), np.stack([j, i, distance])]
        self.held += 2 * len(i)
        if self.held > 10 * _PAIRS:
            self._prune()
        while True:
            a, b = self.classes.label[i], self.classes.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            first = np.unique(np.maximum(a, b)[apart], return_index=True)[1]
            self.forest.append(np.stack([i[first], j[first]]))
            self.classes.add(i[first], j[first])

    def _prune(self) -> None:
        rows = np.unique(np.concatenate(self.rows, axis=1), axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[2], rows[0]))]
        start = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]]) if rows.shape[1] else np.zeros(0, dtype=np.int64)
        rank = np.arange(rows.shape[1]) - np.repeat(start, np.diff(np.r_[start, rows.shape[1]]))
        self.rows = [rows[:, rank < self.most]]
        self.held = 0

    def pairs(self) -> np.ndarray:
        self._prune()
        near = self.rows[0][:2]
        spanned, bridges = Classes(len(self.classes.label)), []
        spanned.add(*near)
        for pairs in self.forest:
            apart = spanned.label[pairs[0]] != spanned.label[pairs[1]]
            bridges.append(pairs[:, apart])
            spanned.add(*pairs[:, apart])
        return np.unique(np.sort(np.concatenate([near, *bridges], axis=1), axis=0), axis=1)


def first_met(apart: np.ndarray, lane: int, path: str, lane_budget: int, parts: int, match: int) -> np.ndarray:
    """Which pairs, given the bits in which they differ, meet in no file before that of lane and path."""
    fresh = np.ones(len(apart), dtype=bool)
    for before in range(lane):
        fresh &= np.bitwise_count(apart[:, before]) > lane_budget
    steps = tuple(map(int, path.split(".")[1:]))
    for depth, k in enumerate(steps):
        for mask in _masks(steps[:depth], parts, match)[:k]:
            fresh &= (apart[:, lane] & np.uint64(mask)) != 0
    return fresh


def _walk(budget: int, lane_budget: int, cap: int, parts: int, match: int, real: bool = False):
    """Arrow function over rows sorted by (lane, path, key): spanning links of each file, or (real) met pairs to verify.

    A pair meets in many files; to be verified it counts in the first of them alone, so it is emitted once, and each
    signature's nearest are among the nearest of some file.
    """

    def links(group: np.ndarray, lane: np.ndarray, path: np.ndarray, node: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        own = sigs[np.arange(len(lane)), lane]
        order = np.lexsort((own, group))
        fps, sigs, node, lane, path = own[order], sigs[order], node[order], lane[order], path[order]
        if real:
            nearest = Nearest(len(fps))

            kinds = [(int(a), b) for a, b in sorted({(int(a), b) for a, b in zip(lane, path)})]
            kind = np.zeros(len(fps), dtype=np.int64)
            for code, (a, b) in enumerate(kinds):
                kind[(lane == a) & (path == b)] = code

            def meet(i: np.ndarray, j: np.ndarray) -> None:
                apart = sigs[i] ^ sigs[j]
                distance = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
                keep = distance <= budget
                i, j, distance, apart = i[keep], j[keep], distance[keep], apart[keep]
                for code in np.unique(kind[i]):
                    here = np.flatnonzero(kind[i] == code)
                    here = here[first_met(apart[here], *kinds[code], lane_budget, parts, match)]
                    nearest.add(i[here], j[here], distance[here])

            trie_links(fps, group, lane_budget, meet)
            i, j = nearest.pairs()
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])
        classes = Classes(len(fps))

        def emit(i: np.ndarray, j: np.ndarray) -> None:
            if sigs.shape[1] > 1:
                near = np.bitwise_count(sigs[i] ^ sigs[j]).sum(axis=1, dtype=np.int64) <= budget
                i, j = i[near], j[near]
            classes.add(i, j)

        trie_links(fps, group, lane_budget, emit)
        moved = np.flatnonzero(classes.label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[classes.label[moved]])], ["u", "v"])

    def taken(rows: pa.Table) -> tuple[np.ndarray, ...]:
        lane, path, key, node = (rows.column(k).to_numpy() for k in range(4))
        sigs = np.stack([rows.column(k).to_numpy() for k in range(4, rows.num_columns)], axis=1).view(np.uint64)
        starts = np.r_[True, (lane[1:] != lane[:-1]) | (path[1:] != path[:-1]) | (key[1:] != key[:-1])]
        return starts, lane, path, node, sigs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            held = fresh if held is None else pa.concat_tables([held, fresh])
            if held.num_rows < cap:
                continue
            starts, lane, path, node, sigs = taken(held)
            bounds = np.flatnonzero(starts)
            at, whole = 0, int(bounds[-1])
            while at < whole:  # slabs of whole files
                nxt = int(bounds[max(np.searchsorted(bounds, at + cap, "right") - 1, np.searchsorted(bounds, at, "right"))])
                yield links(np.cumsum(starts[at:nxt]), lane[at:nxt], path[at:nxt], node[at:nxt], sigs[at:nxt])
                at = nxt
            held = held.slice(whole)
        if held is not None and held.num_rows:
            starts, lane, path, node, sigs = taken(held)
            yield links(np.cumsum(starts), lane, path, node, sigs)

    return run


def _neighbours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (u, v) of rows(keys..., node) that stand next to each other in the order of the keys, within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int] = []
        for batch in batches:
            node = np.r_[np.array(last, dtype=np.int64), batch.column(batch.num_columns - 1).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(node[1:]), pa.array(node[:-1])], ["u", "v"])
            last = [int(node[-1])] if len(node) else []

    ordered = rows.select(*keys, "node").repartitionByRange(*keys).sortWithinPartitions(*keys, "node")
    return ordered.mapInArrow(frugal(run), "u long, v long")


def _stars(rows: DataFrame, keys: list[str], done: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of every node of a group to the group's least node; and the rows of those least nodes."""
    least = stash(rows.groupBy(*keys).agg(F.min("node").alias("least")), "simhash-stars", done)
    met = rows.join(least, keys)
    links = met.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    return links, met.filter("node = least").select(*rows.columns)


def hamming_links(
    nodes: DataFrame, lanes: int, budget: int, parts: int, match: int, cap: int, done: list[str] | None = None, real: bool = False,
    alike: int = 4096, levels: int = 3,
) -> DataFrame:
    """Spanning links (u, v) of the distinct signatures nodes(node, f0, ...) within the budget; pairs to verify if real.

    Pairs to verify need not be met one by one where signatures crowd: more than `alike` of them that share a whole
    lane are proposed to the least of them and to their neighbours in the order of the other lanes, and stand in that
    lane's files by the least alone; files that are still over the cap after `levels` fillings, whose signatures then
    agree on more bits than chance explains, are proposed to their least. So no group is multiplied without end.
    """
    lane_budget = budget // lanes
    if parts - lane_budget < match:
        raise ValueError("a lane within its budget must keep `match` blocks whole")
    names = [f"f{lane}" for lane in range(lanes)]
    level = nodes.select(F.explode(F.array(*map(F.lit, range(lanes)))).alias("lane"), F.lit("r").alias("path"), "node", *names)
    out, keys, depth = None, ["lane", "path", "key"], 0
    if real:
        owned = level.withColumn("own", F.get(F.array(*names), F.col("lane")))
        crowded = stash(owned.groupBy("lane", "own").count().filter(F.col("count") > alike).select("lane", "own"), "simhash-crowds", done)
        if n_crowded := crowded.count():
            side = small_side(crowded, n_crowded)
            crowd = stash(owned.join(side, ["lane", "own"], "left_semi"), "simhash-crowd", done)
            stars, least = _stars(crowd, ["lane", "own"], done)
            out = stars.unionByName(_neighbours(crowd, ["lane", "own", *names]))
            level = stash(owned.join(side, ["lane", "own"], "left_anti").unionByName(least).drop("own"), "simhash-level", done)
    while True:
        depth += 1
        filed = _file(level, parts, match, lanes)
        full = stash(filed.groupBy(*keys).count().filter(F.col("count") > cap).select(*keys), "simhash-full", done)
        n_full = full.count()
        light = filed.join(small_side(full, n_full), keys, "left_anti") if n_full else filed
        walk = _walk(budget, lane_budget, cap, parts, match, real)
        found = light.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(frugal(walk), "u long, v long")
        out = found if out is None else out.unionByName(found)
        if not n_full:
            return out
        level = stash(filed.join(small_side(full, n_full), keys, "left_semi"), "simhash-level", done)
        if real and depth == levels:
            return out.unionByName(_stars(level, keys, done)[0])
        level = level.drop("key")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    lanes: int = 1,
    budget: int = 3,
    parts: int = 4,
    match: int = 1,
    cap: int = 4096,
) -> DataFrame:
    """(doc_id, f0, ..., component_id): one row per document; component_id is the smallest id reachable.

    With several lanes a class is named inside by a 64-bit hash of the signature.
    """
    names = [f"f{lane}" for lane in range(lanes)]
    node = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    prints = stash(signatures(docs, id_col, text_col, words, lanes).withColumn("node", node), "simhash-fp")
    done: list[str] = []
    nodes = stash(prints.groupBy("node", *names).agg(F.min("doc_id").alias("least")), "simhash-nodes", done)
    roots = components(hamming_links(nodes, lanes, budget, parts, match, cap, done), "simhash-cc", done)
    if roots is None:
        return prints.join(nodes.select("node", F.col("least").alias("component_id")), "node").select("doc_id", *names, "component_id")
    rooted = stash(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "simhash-roots", done)
    least = stash(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least", done)
    classes = stash(rooted.join(least, "root").select("node", "component_id"), "simhash-classes")
    discard(docs.sparkSession, done)
    return prints.join(classes, "node").select("doc_id", *names, "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5) -> frozenset[int]:
    """Hashes of the word shingles of a text; a shorter text is one shingle, an empty one has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(tokens) < words:
        return frozenset([_HASH(b" ".join(tokens))] if tokens else [])
    return frozenset(map(_HASH, map(b" ".join, zip(*(tokens[k:] for k in range(words))))))


def alike(links: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The links (u, v) whose texts(h, text) have a Jaccard similarity of five-word shingles of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, frozenset()
        for batch in batches:
            keep = []
            for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if u != last:
                    last, left = u, shingles(a.as_py())
                right = shingles(b.as_py())
                both = len(left & right)
                keep.append(both >= least * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("h").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
    joined = links.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v").sortWithinPartitions("u")
    return joined.mapInArrow(frugal(run), "u long, v long")


def verified_classes(docs: DataFrame, words: int, lanes: int, budget: int, parts: int, match: int, least: float, cap: int = 4096) -> DataFrame:
    """(doc_id, h, component_id, kept_h): the rows of classes of more than one row, with every link verified.

    Texts are named by a 64-bit hash, h; component_id and kept_h name the row that stands for the class, the one with
    the smallest id (ties: the smallest hash).

    Candidates are pairs of signatures within the budget (the nearest of each, and a forest that spans them), and
    the texts that share a signature, each with one of them.
    """
    names, done = [f"f{lane}" for lane in range(lanes)], []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = own.select("doc_id", "h")
    texts = own.select("h", "text")
    prints = stash(signatures(own, "h", "text", words, lanes).withColumnRenamed("doc_id", "h").distinct(), "simhash-fp", done)
    nodes = stash(prints.groupBy(*names).agg(F.min("h").alias("node")), "simhash-nodes", done)  # a signature goes by one of its texts
    near = hamming_links(nodes.select("node", *names), lanes, budget, parts, match, cap, done, real=True).distinct()
    same = prints.join(nodes, names).filter("h <> node").select(F.col("h").alias("u"), F.col("node").alias("v"))
    links = stash(near.unionByName(same), "simhash-met", done)
    needed = links.select(F.col("u").alias("h")).union(links.select("v")).distinct()
    used = stash(texts.join(needed, "h", "left_semi").dropDuplicates(["h"]), "simhash-texts", done)
    roots = components(stash(alike(links, used, least), "simhash-alike", done), "simhash-cc", done)
    rooted = ids.withColumn("root", F.col("h")) if roots is None else ids.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rooted = stash(rooted.select("doc_id", "h", "root"), "simhash-rooted", done)
    # null ids come last: a class is named by its smallest id, and by none only where it has none
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("h"))
    low = rooted.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # a class may hold a third of all rows: its rows meet eight copies of its name
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(8)).cast("int"))
    found = stash(salted.join(low, ["root", "salt"]).select("doc_id", "h", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("kept_h")), "simhash-found")
    discard(docs.sparkSession, done)
    return found


def survivors(
    docs: DataFrame, words: int = 2, lanes: int = 4, budget: int = 27, parts: int = 8, match: int = 2, least: float = 0.8
) -> DataFrame:
    """docs without near-duplicates: of each class one row stays, that with the smallest id (null ids last).

    256 bits over two-word shingles within 27 bits only propose; every link of a class has a five-word Jaccard
    similarity of at least `least`. See the README for what the candidates miss. Rows are told apart by id and text, so
    a row never goes because another of the same id does; of rows that share both, one stays.
    """
    found = verified_classes(docs, words, lanes, budget, parts, match, least)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("kept_h"))
    gone = stash(found.filter(~stays).select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h")).distinct(), "simhash-gone")
    named = docs.withColumn("__text_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__text_h") == F.col("__gone_h"))
    out = named.join(small_side(gone, gone.count()), same, "left_anti")
    repeated = stash(found.filter(stays).groupBy("doc_id", "h").count().filter("count > 1"), "simhash-repeated")
    if repeated.isEmpty():
        return out.select(docs.columns)
    again = repeated.select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h"))
    again = small_side(again, again.count())
    once = out.join(again, same, "left_semi").dropDuplicates(["doc_id", "__text_h"])
    return out.join(again, same, "left_anti").unionByName(once).select(docs.columns)

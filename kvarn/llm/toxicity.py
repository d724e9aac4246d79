"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed single words, word pairs and pairs with one word between. The classifier is
fitted on a bounded sample of labelled rows (`sample_rows`, chosen by a hash of the id, so the choice does not
depend on order or partitions) by one task that reads only that sample; every other row is only scored. Each
coordinate has its own learning rate and an L1 proximal step, so most weights are exactly zero and the fitted
model, at most 2 ** bits weights, is small enough to travel with the scoring tasks.

Nulls and edge cases: a null or empty text has no features and gets the score of the intercept; labels that are
null are not used, of several labels for one id the highest counts, and of several texts the first in order;
without any usable label every score is 0.5 (nothing is known) and nothing is predicted toxic; repeated rows are
scored as often as they occur; an empty table gives an empty result. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import frugal, table

_WORD = re.compile(r"\w+")
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class WordHashes:
    """64-bit hashes of words, remembered in a bounded store."""

    def __init__(self, room: int = 200_000) -> None:
        self.room, self.known = room, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        unseen = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(unseen) > self.room:
            self.known, unseen = {}, set(words)
        for word in unseen:
            raw = word.encode("utf-8", "surrogatepass")
            self.known[word] = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def features(text: str | None, hashes: WordHashes, bits: int) -> np.ndarray:
    """Hashed single words, neighbours and skip pairs of a whole text; repeats included."""
    words = _WORD.findall((text or "").lower())
    h = hashes(words)
    single = h * _ODD[0]
    pairs = (h[:-1] * _ODD[1]) ^ (h[1:] * _ODD[0])
    skips = (h[:-2] * _ODD[2]) ^ (h[2:] * _ODD[0])
    return (np.concatenate([single, pairs * _ODD[2], skips * _ODD[1]]) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 6
    positive_weight: float = 4.0
    sample_rows: int = 16_384


class Ftrl:
    """FTRL-proximal: z and n of each coordinate; weights follow from them."""

    def __init__(self, p: Params) -> None:
        self.p, size = p, (1 << p.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        p, z = self.p, self.z[at]
        l1 = np.where(np.abs(z) <= p.l1, np.abs(z), p.l1)
        w = -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (self.p.positive_weight if label else 1.0)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, int]], p: Params) -> dict[int, float]:
    """Non-zero weights after some passes over rows of (distinct features, label); the last index is the intercept."""
    model, bias = Ftrl(p), 1 << p.bits
    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            model.learn(np.append(at, bias), label)
    w = model.weights()
    return {int(k): float(w[k]) for k in np.flatnonzero(w)}


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), trainable: Column | None = None) -> dict[int, float]:
    """Weights learned from a bounded, hash-chosen sample of the labelled rows."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(~held_out() if trainable is None else trainable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample_rows)  # at most sample_rows rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row an id, so the bound holds for rows too

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(features(t, hashes, p.bits)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], ["doc_id", "toxic", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))]
        seen.sort(key=lambda r: (r[0], r[2]))
        model = train([(np.frombuffer(at, dtype=np.int32), int(toxic > 0)) for _, toxic, at in seen], p) if seen else {}
        columns = [pa.array(list(model), pa.int32()), pa.array(list(model.values()), pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["at", "weight"])

    extracted = rows.mapInArrow(frugal(extract), "doc_id long, toxic int, at binary")
    return {r["at"]: r["weight"] for r in extracted.repartition(1).mapInArrow(frugal(learn), "at int, weight double").collect()}


def score(
    docs: DataFrame, model: dict[int, float], p: Params = Params(), keep: list[str] | None = None, name: str = "score"
) -> DataFrame:
    """docs[keep] with a score of the whole text between 0 and 1 in column name; keep defaults to doc_id."""
    keep = keep or ["doc_id"]
    places = np.array(sorted(model), dtype=np.int32)
    values = np.array([model[k] for k in places.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = WordHashes(), np.zeros((1 << p.bits) + 1)
        weights[places] = values
        for batch in batches:
            logits = np.full(batch.num_rows, weights[-1])
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                at = features(text.as_py(), hashes, p.bits)
                at = np.unique(at[weights[at] != 0])
                logits[k] += weights[at].sum()
            scores = pa.array(1 / (1 + np.exp(-np.clip(logits, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], name])

    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    frame = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("__kvarn_text"))
    return frame.mapInArrow(frugal(run), kept.withColumn(name, F.lit(0.0)).schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows scored at or above the threshold."""
    mark = "__kvarn_toxicity"
    scored = score(docs, fit(docs, labels), keep=docs.columns, name=mark)
    return scored.filter(F.col(mark) < threshold).drop(mark)

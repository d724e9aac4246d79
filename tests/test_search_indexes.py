"""Indexes that skip: BM25 blocks, cells of vectors, keywords by rolling hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvarn.functions import metadata as M
from kvarn.operators import search


def documents(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(30)]
    rows = [(rng.choice(["a", "b"]), k, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for k in range(n)]
    rows += [("a", 9000 + k, "w3 w4") for k in range(60)] + [("c", 1, ""), ("c", 2, "nothing"), ("c", 3, None)]
    return spark.createDataFrame(rows, "collection string, sid long, text string")


@pytest.mark.parametrize("query", ["w29 w3 w3", "w0", "w0 w1 w2 w28", "absent", "W27"])
def test_pruned_ranks_equal_all_scores(spark, tmp_path, query):
    rows = documents(spark)
    index = search.Bm25Index.build(rows, range_rows=8)
    index.save(f"{tmp_path}/ix")
    saved = search.Bm25Index.load(spark, f"{tmp_path}/ix")
    keep = rows.filter("sid % 3 = 0").select("sid").distinct()
    scores = {(r.collection, r.sid): r.bm25 for r in index.scores(query).collect()}
    for given, chosen, most in ((index, None, 40), (saved, None, 3), (saved, keep, 5)):
        want = set()
        for name in "abc":
            mine = sorted((-s, sid) for (c, sid), s in scores.items() if c == name and (chosen is None or sid % 3 == 0))
            want |= {(name, sid, -s, k) for k, (s, sid) in enumerate(mine[:most], 1)}
        got = given.search(query, most, chosen).select("collection", "sid", "bm25", "bm25_rank").collect()
        assert {tuple(r) for r in got} == want


def test_lengths_are_read_only_where_hits_are_few(spark, tmp_path):
    rows = documents(spark).filter("collection <> 'c'")
    search.Bm25Index.build(rows, range_rows=8).save(f"{tmp_path}/ix")
    index = search.Bm25Index.load(spark, f"{tmp_path}/ix")
    plan = lambda q: index.search(q, 5)._jdf.queryExecution().optimizedPlan().toString()
    files = lambda q: {f.rsplit("/", 2)[-2] for f in index.search(q, 5).inputFiles()}
    assert "lengths" not in files("w20 w25") and "lengths" in files("absent")
    assert "LeftAnti" not in plan("w20 w25")


def test_low_ranges_are_not_read(spark):
    """Of documents that all hold a frequent word, only the ranges with the rare one are scored in the end."""
    rows = spark.createDataFrame([("c", k, "often " * (1 + k % 3) + ("rare" if k % 100 == 0 else "")) for k in range(4000)], "collection string, sid int, text string")
    index = search.Bm25Index.build(rows, range_rows=16)
    weighed = index._weighed(search.Counter(["often", "rare"]))
    heads = weighed.groupBy("collection", "range").agg(F.sum(F.greatest(F.col("weight") * F.col("top"), F.lit(0.0))).alias("bound"))
    bar = index.search("often rare", 10).agg(F.min("bm25")).first()[0]
    assert heads.filter(F.col("bound") + 1e-6 >= bar).count() < 0.7 * heads.count()


def clustered(n=6000, size=16, seed=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 10, (60, size))
    return [("ab"[k % 2], k, (middles[k % 60] + rng.normal(0, 0.3, size)).astype(np.float32).tolist()) for k in range(n)]


def test_cells_give_all_neighbours_from_few_rows(spark, tmp_path):
    rows = clustered()
    frame = spark.createDataFrame(rows + [("a", 10**6, None), ("z", 10**6 + 1, [1.0] * 4)], "collection string, sid long, embedding array<float>")
    index = search.VectorIndex.build(frame, f"{tmp_path}/cells", cells=64)
    query = [x + 0.05 for x in rows[17][2]]
    whole = {tuple(r) for r in search.dense(frame.filter("sid < 1000000"), query, 10).select("collection", "sid", "distance", "dense_rank").collect()}
    found = search.VectorIndex(spark, f"{tmp_path}/cells").search(query, 10)
    assert {tuple(r) for r in found.collect()} == whole
    index.search(query, 10)
    read = index.candidates(index.read_cells, 16).count()
    assert 20 <= read < 0.1 * len(rows)
    some = frame.filter("sid % 7 = 0").select("sid")
    want = {tuple(r) for r in search.dense(frame.filter("sid < 1000000 AND sid % 7 = 0"), query, 10).select("collection", "sid", "distance", "dense_rank").collect()}
    assert {tuple(r) for r in index.search(query, 10, among=some).collect()} == want
    assert {r.collection for r in index.search(query, 10, F.col("collection") == "a").collect()} == {"a"}
    assert [r.sid for r in index.search([1.0] * 4, 3).collect()] == [10**6 + 1] and index.search([0.0] * 5, 3).count() == 0


def test_equal_vectors_and_more_wanted_than_there_are(spark, tmp_path):
    frame = spark.createDataFrame([("a", k, [1.0, 2.0]) for k in range(300)], "collection string, sid int, embedding array<double>")
    index = search.VectorIndex.build(frame, f"{tmp_path}/cells")
    assert [r.sid for r in index.search([1.0, 2.0], 5).orderBy("dense_rank").collect()] == [0, 1, 2, 3, 4]
    assert index.search([5.0, 5.0], 1000).count() == 300


def test_keywords_of_any_length(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abé 漢-", k=n))
    chunks = [(f"{k}", rng.choice(["nms", "x"]), text(rng.choice([0, 3, 50, 400]))) for k in range(60)] + [("n", "nms", None), ("u", "nms", "VLAN Überholt")]
    words = {(d, text(rng.randint(1, 12)), f"c{rng.randint(0, 40)}") for _ in range(300) for d in ("nms", "x")} | {("nms", "vlan", "vlan"), ("nms", "überHOLT", "u"), ("nms", "", "none")}
    frame = spark.createDataFrame(chunks, "chunk_id string, domain string, text string")
    registry = spark.createDataFrame(sorted(words), "domain string, keyword string, concept string")
    want = {i: sorted({c for dd, w, c in words if dd == d and w and t is not None and w.lower() in t.lower()}) for i, d, t in chunks}
    for options in ({}, {"anchor": 3}, {"words_at_once": 100}):
        assert {r.chunk_id: r.concepts or [] for r in M.concepts_by_join(frame, registry, **options).collect()} == want


def test_a_million_keywords(spark):
    n = 1_000_000
    registry = spark.range(n).select(F.lit("d").alias("domain"), F.concat(F.lit("Key"), F.col("id"), F.lit("word")).alias("keyword"), F.col("id").cast("string").alias("concept"))
    rows = spark.createDataFrame([(f"{k}", "d", f"some key{k * 7919 % n}word and KEY{k}WORD, key12wor") for k in range(200)], "chunk_id string, domain string, text string")
    found = M.concepts_by_join(rows, registry)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.chunk_id: r.concepts for r in found.collect()} == {f"{k}": sorted({str(k * 7919 % n), str(k)}) for k in range(200)}


def test_keyword_join_equals_the_expression(spark):
    words = {"the ": "article", "Version 2": "version", "que": "que", "a": "letter"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit("general").alias("domain"))
    registry = spark.createDataFrame([("general", k, v) for k, v in words.items()], "domain string, keyword string, concept string")
    want = {r[0]: r[1] for r in docs.select("chunk_id", M.concepts(F.col("text"), "general", {"general": words})).collect()}
    assert {r.chunk_id: r.concepts or [] for r in M.concepts_by_join(docs, registry).collect()} == want


def test_texts_full_of_keywords_are_not_repeated(spark, monkeypatch):
    """A worker's memory follows the texts, not the texts times the keywords that each holds."""
    words = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    frame = spark.createDataFrame([("a", "d", "x")], "chunk_id string, domain string, text string")
    registry = spark.createDataFrame([("d", w, w) for w in words], "domain string, keyword string, concept string")
    steps, make = [], type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, *more, **other: steps.append(run) or make(self, run, *more, **other))
    M.concepts_by_join(frame, registry)
    texts = [" ".join(words) + " " + "-" * 20_000] * 50
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(50)]), pa.array(["d"] * 50), pa.array(texts)], ["id", "domain", "low"])
    before, rows = pa.total_allocated_bytes(), 0
    for out in steps[-1](iter([batch])):
        rows += out.num_rows
        assert pa.total_allocated_bytes() - before < 8 << 20
    assert rows == 50 * 400


def test_equal_runs_of_a_short_anchor_give_one_place():
    codes = M._codes("abcabdab")
    anchors = M._Anchors({2: np.sort(np.unique(next(h for n, h in M._rolled(codes, 2) if n == 2))), 3: np.array([0], dtype=np.uint64)})
    found = {n: ["abcabdab"[p : p + n] for p in at] for n, at, _ in anchors.hits(codes, 8)}
    assert sorted(found[2]) == ["ab", "bc", "bd", "ca", "da"] and found[3] == []
    assert [len(at) for _, at, _ in anchors.hits(codes)] == [7, 0]


def test_places_of_keywords_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(M, "_ROWS_AT_ONCE", 7)
    chunks = spark.createDataFrame([("a", "d", "x y z " * 9), ("b", "d", "zz"), ("c", "e", "x")], "chunk_id string, domain string, text string")
    registry = spark.createDataFrame([("d", w, w) for w in ("x", "y", "z", " ", "x y", "zz", "y z x", "z x y z x y z")], "domain string, keyword string, concept string")
    got = {r.chunk_id: r.concepts for r in M.concepts_by_join(chunks, registry).collect()}
    assert got == {"a": sorted([" ", "x", "x y", "y", "y z x", "z", "z x y z x y z"]), "b": ["z", "zz"], "c": None}
    keys = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["d"])], ["id", "domain"])
    assert M._spots(keys, [(0, 1, 7, "x")] * 3).schema.names == ["id", "domain", "size", "hash", "seen"]

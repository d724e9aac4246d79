"""Yinyang clustering, lexical search and url rules against plain loops."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from kvarn.llm import lexical, registry, url_rules, yinyang
from tests.parity import rows_of, sql_rows

SF = "/root/testdata/sf0.001"
NEW = ["op11_yinyang_clusters", "op12_lexical_search", "op13_url_rules"]


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(spark, name):
    names, want = sql_rows(SF, registry.ORACLES[name])
    frame = registry.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == names
    assert rows_of(frame) == want


# --- clustering ---------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, scale, dims, seed=1):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = lambda i: (i is None, "" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centers = [v for _, v in sorted(kept, key=lambda r: (drawn(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centers[c] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, near(v)) for i, v in kept]
    top = (1 << 63) - 1
    inertia = {c: sum(min(d, top) for _, (d, o) in out if o == c) for c in range(len(centers))}
    total = min(sum(inertia.values()), top)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, min(d, top), min(inertia[c], top), total, sha[c]) for i, (d, c) in out), key=repr)


def clusters(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("cluster", "distance", "upper", "inertia", "label"):
        frame = frame.withColumn(name, F.lit("clash"))
    return sorted((tuple(r) for r in yinyang.cluster(frame, **options).collect()), key=repr)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(n, [rng.choice([-1.5, 0.0, 0.25, 2.0]) + rng.random() for _ in range(6)]) for n in range(150)]
    rows += [(7, rows[7][1])] * 60 + [(None, [0.5] * 6), (None, [0.25] * 6), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None])]
    rows += [(904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1e200, -1e200, 0.0, 0.0, 0.0, 0.0]), (907, [3e9] * 6)]
    for options in ({"k": 5, "rounds": 4}, {"k": 9, "rounds": 2, "group_size": 2}, {"k": 400, "rounds": 1}):
        assert clusters(spark, rows, dims=6, scale=64, **options) == plain_clusters(rows, options["k"], options["rounds"], 64, 6)


def test_no_vectors(spark):
    empty = clusters(spark, [], k=4)
    assert empty == [] == clusters(spark, [(1, None)], k=4)
    only = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.cluster(only).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_go_to_the_smaller_centroid():
    model = yinyang.Model([[0, 0], [4, 0], [0, 4]], np.array([0, 1, 1]))
    own, upper, lower = model.start(np.array([[2.0, 0.0], [2.0, 2.0], [4.0, 1.0]]))
    assert own.tolist() == [0, 0, 1] and upper[0] == 2 and lower[0].tolist() == [np.inf, 2]
    moved = yinyang.Model([[0, 0], [4, 0], [2, 2]], np.array([0, 1, 1]), [[0, 0], [4, 0], [0, 4]])
    assert moved.advance(np.array([[2.0, 0.0], [2.0, 2.0], [4.0, 1.0]]), own, upper, lower)[0].tolist() == [0, 2, 1]


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (40, 16))
    x = np.concatenate([m + rng.integers(-40, 40, (100, 16)) for m in middles]).astype(float)
    centers = [[int(v) for v in x[100 * k]] for k in range(40)]
    group = yinyang.group_centroids(centers, 4)
    own, upper, lower = yinyang.Model(centers, group).start(x)
    moved = [[int(v) for v in x[own == c].sum(axis=0) // (own == c).sum()] for c in range(40)]
    model = yinyang.Model(moved, group, centers)
    again, _, _ = model.advance(x, own, upper, lower)
    assert model.measured < 0.05 * len(x) * 40
    assert (again == ((x[:, None] - np.array(moved)[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_limbs_hold_any_sum():
    for value in (0, 1, -1, 1 << 40, -(1 << 40) - 1, 3**300, -(7**200)):
        limbs = yinyang._limbs(value)
        assert sum(v << (yinyang.LIMB * j) for j, v in enumerate(limbs)) == value and all(abs(v) <= 1 << yinyang.LIMB for v in limbs)


# --- lexical search -----------------------------------------------------------------------------------------------


def plain_ranks(docs, items, k):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: pattern.findall((t or "").translate(lower))
    held = [(i, w) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for i, w in held:
            m = 25 + 75 * len(w) * n // total
            score = 0
            for term in words(text):
                df, tf = sum(term in set(v) for _, v in held), w.count(term)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_ranks_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(40)] + ["Été", "ñandú", "it's", "a-b", "x_y", "10", "漢字"]
    weights = [60, 50, 40] + [1] * (len(vocabulary) - 3)
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(n, text(rng.choice([1, 3, 20, 200]))) for n in range(90)]
    docs += [(500 + n, docs[5][1]) for n in range(40)] + [(500, docs[5][1]), (None, docs[5][1]), (None, docs[6][1]), (600, None), (601, ""), (602, " .,; \n")]
    docs.append((603, "w7 " * 30_000))
    items = [(n, text(15)) for n in range(12)] + [(3, "w7 w7 W7"), (None, "w1 été w30"), (50, None), (51, ""), (52, "nowhere"), (53, docs[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for name in ("term", "shard", "df", "score", "block", "item_row"):
        frame, asked = frame.withColumn(name, F.lit("clash")), asked.withColumn(name, F.lit("clash"))
    want = plain_ranks(docs, items, 7)
    for size, block in ((1 << 25, 65_536), (600, 40)):
        index = lexical.build(frame, shard_bytes=size)
        assert sorted((tuple(r) for r in lexical.search(index, asked, k=7, block_terms=block).collect()), key=repr) == want


def test_nothing_to_rank(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert lexical.search(lexical.build(docs), asks).collect() == [] == lexical.search(lexical.build(some), items).collect()
    assert [tuple(r)[:3] for r in lexical.search(lexical.build(some), asks).collect()] == [(1, 1, 1)]


def test_bytes_of_numbers_round_trip():
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 62) - 1, 5], dtype=np.int64)
    packed, size = lexical.pack(numbers)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 9, 1] and lexical.unpack(packed.tobytes()).tolist() == numbers.tolist()
    assert lexical.unpack(b"").tolist() == []


def test_lists_of_frequent_words_are_skipped():
    lists = {b"often": list(range(5000)), b"rare": [17, 400, 4999]}
    builder = lexical.ShardBuilder()
    for n in range(5000):
        builder.add(n, b"often pad" + b" rare" * (n in lists[b"rare"]))
    rows = builder.rows(0).to_pylist()
    shard = lexical.Shard(rows[0]["ids"], rows[0]["postings"], 5000, 10_003, {r["term"]: (r["df"], r["postings"]) for r in rows[1:]})
    found = shard.best([(b"often", 1), (b"rare", 9000)], 3)
    assert sorted(place for _, place in found) == [17, 400, 4999]
    assert sorted(shard.best([(b"often", 1)], 3)) == sorted((shard.lists[b"often"][1][p], p) for p in (0, 1, 2))


# --- url rules ----------------------------------------------------------------------------------------------------


def plain_verdicts(urls, rules, default="allow"):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for page, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            host, path = host.translate(lower), slash + path
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v) and (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, False, None, default))
        out.append((page, host, path, best[3], best[4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_verdicts_equal_brute_force(spark, parts):
    rng = random.Random(parts)
    labels, steps = ["a", "b", "ab", "net", "x-y", "ünï", "z0"], ["", "en", "en/", "e", "de/x", "日本"]
    name = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    urls = [(n, f"{rng.choice(['http', 'HTTPS', ''])}://{name().upper() if n % 5 == 0 else name()}/{rng.choice(steps)}/{rng.choice(['', '?q=1', '#t'])}") for n in range(400)]
    urls += [(1000 + n, f"http://a.net/en/{n}") for n in range(300)] + [(9, "http://a.net/en/1")] * 200
    urls += [(None, "http://a.b/en"), (1, None), (2, ""), (3, "nothing here"), (4, "://"), (5, "http://?x"), (6, "http://a..b./en/"), (7, "x" * 20_000 + "://a.net/e"), (8, "http://u@a.net:80/")]
    rules = [(name(), f"/{rng.choice(steps)}", rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [("a.net", "/en/", "allow"), ("a.net", "/en/", "block"), ("", "/e", "block"), (None, "/", "block"), ("b", None, "block"), ("b", "/", None), ("a.net", f"/en/{77}", "allow")]
    rules = [(h, p, v) for h, p, v in dict.fromkeys(rules)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("part", F.lit("clash")).repartition(3)
    given = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("key", F.lit("clash"))
    frame = url_rules.judge(pages, given, rows_per_part=100, parts=parts)
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == plain_verdicts(urls, rules)


def test_empty_url_tables(spark):
    none, no_rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.net/x?y")], "page_id long, url string")
    assert url_rules.judge(none, no_rules).collect() == []
    assert [tuple(r) for r in url_rules.judge(one, no_rules, default="block").collect()] == [(1, "a.net", "/x", None, "block")]


def test_every_rule_reaches_the_parts_of_its_urls():
    rng = random.Random(2)
    keys = [".".join(rng.choices("abc", k=rng.randint(1, 3))) + "." for _ in range(200)]
    spots = [(k, "/" + "".join(rng.choices("xy", k=rng.randint(0, 3)))) for k in keys]
    bounds = sorted(rng.choices(spots, k=12))
    for prefix, start in rng.choices(spots, k=60):
        parts = set(url_rules.rule_parts(bounds, prefix, start))
        for turn, (k, p) in enumerate(spots):
            if k.startswith(prefix) and p.startswith(start):
                assert url_rules.url_part(bounds, (k, p), turn) in parts


def test_a_shard_is_written_in_little_memory():
    """Beside the collected numbers a sort key and an order for each posting; the rest of a batch's size."""
    rng, builder = random.Random(8), lexical.ShardBuilder()
    for k in range(4000):
        builder.add(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(50)).encode())
    postings, write = len(builder.which), getattr(builder, "batches", lambda shard, most: iter([builder.rows(shard)]))
    tracemalloc.start()
    found = sum(int(pc.sum(b["df"]).as_py()) - (4000 if b["term"][0].as_py() == b"" else 0) for b in write(1, most=256))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == postings and peak < 64 * postings

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kvarn.llm import simhash as S
from kvarn.llm.components import components


def brute_fingerprint(text: str) -> int:
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: list[int], budget: int) -> list[int]:
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@given(st.text(alphabet="aB é\t\n\x1c", max_size=80))
def test_fingerprint(text):
    assert int(S.signature(text)[0]) == brute_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0] % 2**64
    assert got == xxhash.xxh64_intdigest("a b é".encode(), seed=42)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 6), st.lists(st.integers(0, 63), max_size=5))
def test_trie_walk_finds_all_links(values, budget, flips):
    values = sorted({v ^ (1 << f) for v in values for f in flips} | set(values))
    fps, found = np.array(values, dtype=np.uint64), set()
    S.trie_links(fps, np.ones(len(fps), dtype=int), budget, lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    want = {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= budget}
    assert found == want


@pytest.mark.parametrize("cap", [64, 4096])
def test_classes_of_dense_groups(spark, cap):
    """A ball of near fingerprints, which is filed again and again under a small cap, and scattered ones."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    prints = {centre}
    for _ in range(400):
        fp = centre
        for bit in rng.choice(64, rng.integers(1, 7), replace=False):
            fp ^= 1 << int(bit)
        prints.add(fp)
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)}
    prints = sorted(prints)
    signed = [(int(np.array([p], dtype=np.uint64).view(np.int64)[0]),) * 2 for p in prints]
    nodes = spark.createDataFrame(signed, "node long, f0 long")
    roots = components(S.hamming_links(nodes, 1, 3, 4, 1, cap))
    got = {r.node: r.root for r in roots.collect()}
    mine = [got.get(s[0], s[0]) for s in signed]
    want = brute_classes(prints, 3)
    pairs = {(a, b) for a, b in zip(mine, want)}
    assert len(pairs) == len(set(mine)) == len(set(want))


def test_lanes_are_exact(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4)
    rows = []
    for k in range(80):
        sig = base.copy()
        for bit in rng.choice(256, 4 * (k % 9), replace=False):
            sig[bit // 64] ^= 1 << int(bit % 64) if bit % 64 < 63 else 0
        rows.append((k, *map(int, sig)))
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    got = {r.node: r.root for r in components(S.hamming_links(nodes, 4, 27, 8, 2, 4096)).collect()}
    wide = [sum(int(x) % 2**64 << 64 * k for k, x in enumerate(r[1:])) for r in rows]
    want = brute_classes(wide, 27)
    mine = [got.get(r[0], r[0]) for r in rows]
    assert len({*zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_path_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len({got[k] for k in range(61)}) == 1 and got[100] == got[101] != got[0]


def test_query_equals_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.f0 % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()}
    prints = [brute_fingerprint(r.text or "") for r in rows]
    label = brute_classes(prints, 3)
    least = {c: min(r.doc_id for r, x in zip(rows, label) if x == c) for c in set(label)}
    assert got == {r.doc_id: (p, least[c]) for r, p, c in zip(rows, prints, label)}


def test_odd_rows(odd_docs, no_docs):
    out = S.near_duplicates(odd_docs).collect()
    assert len(out) == 11
    by_id = {r.doc_id: r.component_id for r in out}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == by_id[5] == by_id[9] == 4
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "None"])
    assert S.survivors(no_docs).count() == 0


def jaccard(a: str, b: str) -> float:
    sets = []
    for text in (a, b):
        w = text.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_survivors_drop_near_copies_only(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(800)]
    originals = [" ".join(rng.choice(vocabulary, 200)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(originals)]
    near = 0
    for k, text in enumerate(originals):
        words = text.split()
        words[10] = words[100] = "changed"
        near += jaccard(text, " ".join(words)) >= 0.8
        rows.append((100 + k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in S.survivors(frame).collect()}
    assert set(range(40)) <= kept and near == 40
    assert len(kept) <= 42


def test_survivors_keep_what_no_verified_link_removes(spark):
    """Texts within the bit budget whose five-word similarity is under 0.8 both stay; a chain of verified links still removes."""
    for seed in range(50):
        rng = np.random.default_rng(seed)
        words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
        far, near = list(words), list(words)
        for k in range(5, 400, 44):
            far[k] = "changed"
        near[200] = "other"
        texts = [" ".join(w) for w in (words, far, near)]
        prints = [S.signature(t, 2, 4) for t in texts]
        if max(np.bitwise_count(prints[0] ^ p).sum() for p in prints) <= 27:
            break
    else:
        pytest.fail("no pair within the budget")
    assert jaccard(texts[0], texts[1]) < 0.8 <= jaccard(texts[0], texts[2])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in S.survivors(frame).collect()} == {0, 1}


def test_rows_of_one_id_are_told_apart(spark):
    a, b = "one two three four five six seven", "quite another text with other words in it"
    frame = spark.createDataFrame([(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b, "w"), (None, a, "v"), (2, b, "z")], "doc_id long, text string, h string")
    got = sorted((r.doc_id, r.text) for r in S.survivors(frame).collect())
    assert got == [(1, a), (2, b)]


@pytest.mark.parametrize(("alike", "cap", "levels"), [(20, 4096, 3), (10_000, 16, 2), (20, 16, 2)])
def test_crowded_signatures_end_and_stay_together(spark, alike, cap, levels):
    """Hundreds of signatures that share a whole lane, or crowd within a few bits, make one class of proposals."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    sigs = {tuple(base)}
    while len(sigs) < 400:
        sig = base.copy()
        for lane in rng.integers(1, 4, 4):
            sig[lane] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        sigs.add(tuple(sig))
    far = [tuple(rng.integers(0, 2**63, 4, dtype=np.uint64)) for _ in range(50)]
    rows = [(k, *(int(x) for x in np.array(s, dtype=np.uint64).view(np.int64))) for k, s in enumerate([*sigs, *far])]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    links = S.hamming_links(nodes, 4, 27, 8, 2, cap, real=True, alike=alike, levels=levels)
    near = {(r.u, r.v) for r in links.collect() if r.u < 400 and r.v < 400}
    label = list(range(400))
    for _ in range(12):
        for u, v in near:
            label[u] = label[v] = min(label[u], label[v])
    assert set(label) == {0} and len(near) < 400 * 40

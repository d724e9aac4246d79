import io
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kvarn.llm import bitplanes as B
from kvarn.llm import packing as P
from kvarn.llm.base import scratch
from kvarn.llm.encoder import Encoder, vocabulary_path


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


ENCODER = Encoder(vocabulary_path(), room=50)


@settings(deadline=None, max_examples=1000)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n", max_size=40), st.text(alphabet="aé 'st\n\t1²×·ßЖ漢  \x1c\xa0\u2003", max_size=60)))
def test_encoder_equals_library(library, text):
    assert ENCODER.encode([text]) == [library(text)]


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "hello", " world", "é", "endoftext"]), max_size=9))
def test_added_tokens_in_texts(library, parts):
    assert ENCODER.encode(["".join(parts)]) == [library("".join(parts))]


def test_added_token_is_one_id():
    ids = np.frombuffer(ENCODER.encode(["hello <|endoftext|> world"])[0], dtype="<u4")
    assert ids.tolist() == [31373, 220, 50256, 995]


def test_encoder_on_documents(library, docs):
    texts = [r.text for r in docs.collect()] + [None, "", "it's <|endoftext|> 漢字"]
    assert ENCODER.encode(texts) == [library(t) for t in texts]


@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_packs_all_without_gaps(lengths):
    bins, count = defaultdict(list), Counter()
    for run in P.plan(Counter(lengths), 64):
        for k in range(run.count):
            bins[run.bin + k // run.per_bin].append((run.offset + k % run.per_bin * run.length, run.length))
        count[run.length] += run.count
    assert count == Counter(lengths)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
        assert sum(3 * n > 64 for _, n in items) <= 2
    if lengths:  # no two sequences could be one
        loads = sorted(sum(n for _, n in items) for items in bins.values())
        assert len(loads) < 2 or loads[0] + loads[1] > 64


def test_large_pairs_are_best():
    assert max(r.bin + (r.count - 1) // r.per_bin for r in P.plan({40: 3, 24: 2, 25: 1}, 64)) + 1 == 4


@given(st.integers(1, 9000))
def test_cut(n):
    parts = P.cut(n, 2048)
    assert sum(size for _, size in parts) == n and all(size == 2048 for _, size in parts[1:])
    assert [s for s, _ in parts] == list(np.cumsum([0, *(size for _, size in parts[:-1])]))


def check_packing(rows, want, capacity):
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [2048, 300])
def test_packing_equals_brute_force(docs, library, capacity):
    want = []
    for r in docs.collect():
        ids = library(r.text) + bytes(4)
        want += [(str(r.doc_id), k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(P.cut(len(ids) // 4, capacity))]
    check_packing(P.pack(docs, capacity).collect(), want, capacity)


def test_packing_odd_rows(odd_docs, no_docs, library):
    want = []
    for r in odd_docs.collect():
        ids = library(r.text) + bytes(4)
        want += [(str(r.doc_id), k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(P.cut(len(ids) // 4, 2048))]
    check_packing(P.pack(odd_docs).collect(), want, 2048)
    assert P.pack(no_docs).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from([4, 32]))
def test_planes_round_trip(ids, planes):
    array = np.array(ids, dtype="<u4")
    parts = [p if p.strip(b"\0") else b"" for p in B.to_planes(array, planes)]
    assert B.from_planes(parts, len(array)).tolist() == ids


@pytest.mark.parametrize("planes", [4, 32])
def test_file_round_trip_and_random_access(planes):
    rng = np.random.default_rng(1)
    docs = [(k if k != 3 else None, rng.integers(0, 50_000, n, dtype="<u4")) for k, n in enumerate([5, 1, 300, 0, 64, 65, 1000])]
    sink = io.BytesIO()
    sink.close_now = sink.close
    writer = B.Writer(sink, planes, block=64)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.tobytes())
    writer.close()
    reader = B.Reader(io.BytesIO(sink.getvalue()))
    everything = np.concatenate([ids for _, ids in docs])
    assert reader.docs == [d for d, _ in docs] and reader.lengths.tolist() == [len(ids) for _, ids in docs]
    assert list(reader.checksums()) == [zlib.crc32(ids.tobytes()) for _, ids in docs]
    for first, count in ((0, 1), (63, 2), (100, 500), (len(everything) - 1, 1), (7, 0)):
        assert reader.ids(first, count).tolist() == everything[first : first + count].tolist()
    damaged = bytearray(sink.getvalue())
    damaged[-60] ^= 1
    with pytest.raises(ValueError):
        B.Reader(io.BytesIO(bytes(damaged)))


def brute_table(rows, library, end_id):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = library(r.text) + np.array([end_id], dtype="<u4").tobytes()
        out.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


@pytest.mark.parametrize("file_ids", [1 << 26, 2000])
def test_files_equal_brute_force(spark, docs, odd_docs, library, file_ids):
    for frame in (docs, odd_docs):
        folder = scratch(spark, "test-planes")
        B.write(frame, folder, file_ids=file_ids, block=512, shards=3)
        got = sorted((tuple(r) for r in B.read(spark, folder).collect()), key=lambda r: r[1])
        assert got == brute_table(frame.collect(), library, 2)
        fs, base = B.filesystem(folder)
        with fs.open_input_stream(f"{base}/manifest.json") as source:
            files = json.loads(source.read())["files"]
        assert (len(files) > 3) == (file_ids == 2000)


def test_no_documents(spark, no_docs):
    folder = scratch(spark, "test-planes")
    B.write(no_docs, folder)
    assert B.read(spark, folder).count() == 0

import hashlib
import html
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvarn.llm import decontaminate as D
from kvarn.llm import html_text as H
from kvarn.llm import pii, quotes, toxicity
from kvarn.llm import topk as K

from .conftest import SF

# exact top-k


@given(st.integers(-5000, 5000))
def test_signed_digits(value):
    digits = K.signed_digits(value)
    assert sum(s << at for at, s in digits) == value
    assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


@settings(deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=70, max_size=70), min_size=1, max_size=9), st.data())
def test_bitmap_sums_and_selection(maps, data):
    where = [data.draw(st.integers(0, 3)) for _ in maps]
    bits = np.array(maps, dtype=np.uint8)
    want = sum(bits[k].astype(int) << w for k, w in enumerate(where))
    levels = {w: [K._bitmaps(bits[[k for k, x in enumerate(where) if x == w]])] for w in set(where)}
    slices = K.add_slices(levels, 2)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:70].astype(int) << k for k, s in enumerate(slices))
    assert got.tolist() == want.tolist()
    valid = K._bitmaps(np.ones((1, 70), dtype=np.uint8))[0]
    for k in (1, 5, 70):
        value = K.kth_largest(slices, valid, k)
        assert value == sorted(want)[-k]
        above = np.unpackbits(K.at_least(slices, valid, value).view(np.uint8), bitorder="little")[:70]
        assert above.tolist() == (want >= value).astype(int).tolist()


@pytest.mark.parametrize("spread", [3, 200, 100_000])
def test_block_equals_products(spread):
    rng = np.random.default_rng(spread)
    ids, values = rng.permutation(900), rng.integers(-spread, spread + 1, (900, 12))
    values[100:400] = values[100]  # a very common vector
    block = K.Block(ids, values)
    for query_id in (int(ids[100]), int(ids[5]), -1):
        query = values[100] if query_id == ids[100] else rng.integers(-spread, spread + 1, 12)
        scores, own = values @ query, ids != query_id
        best = np.lexsort((ids[own], -scores[own]))[:5]
        got = block.top(query_id, query, 5)
        assert got[0].tolist() == ids[own][best].tolist() and got[1].tolist() == scores[own][best].tolist()


def test_search_in_small_cells(spark):
    from ..parity import rows_of, sql_rows

    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = K.search(rows.withColumn("rank", F.lit("clash")), F.col("vec_id") % 50 == 0, block_rows=60, lane_rows=3)
    assert rows_of(got) == sql_rows(SF, K.SQL)[1]


def test_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.0]),
            (100, [2.0]), (150, []), (151, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in K.search(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 7, -65536), (100, 1, 6, 131072), (150, 1, 151, 0)]
    assert K.search(frame.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_repeats_and_large_values(spark):
    """Repeated queries get their own answers; any finite value is exact, and scores past a long are shown as its end."""
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 40)] + [(50, [1.0, 0.0, 0.0, 0.0])] * 2 + [(60, [3e9, 1.0, 0.0, 0.0]), (61, [1e308, 0.0, 0.0, 0.0]), (100, [-1e12, 2.0, 0.0, 0.0])]
    got = K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block_rows=20).collect()
    exact = {k: K.whole(v, 256) for k, v in rows}
    score = lambda a, b: min(max(sum(x * y for x, y in zip(exact[a], exact[b])), K.LONG[0]), K.LONG[1])
    want = []
    for q, _ in [r for r in rows if r[0] % 50 == 0]:
        best = sorted(((score(q, i), i) for i, _ in rows if i != q), key=lambda f: (-f[0], f[1]))[:5]
        want += [(q, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


# personal data


def brute_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p, ok=lambda s: True: [m.span() for m in re.finditer(p, text) if ok(m[0])]
    return {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..-+%_ 0123456789()", max_size=50))
def test_base_spans(text):
    base = pii.base_spans(text)
    assert base == brute_spans(text)
    for kind, spans in pii.all_spans(text, base).items():
        assert set(base[kind]) <= set(spans)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("write john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
    ("john [at] example [dot] co [dot] uk", "email", "john [at] example [dot] co [dot] uk"),
    ("contact john at example dot com please", "email", "john at example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊｏｈｎ＠ｅｘ.ｃｏ", "email", "ｊｏｈｎ＠ｅｘ.ｃｏ"),
    ("j​ohn@example.com", "email", "j​ohn@example.com"),
    ("call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
    ("+１ ４１５ 555 2671", "phone", "+１ ４１５ 555 2671"),
    ("card four " + "one " * 15, "card", ("four " + "one " * 15).strip()),
    ("192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
    ("192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
    ("one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
    ("+1 415 five five five 2671", "phone", "+1 415 five five five 2671"),
    ("+49 eins fünf eins 1234 567", "phone", "+49 eins fünf eins 1234 567"),
    ("card 4l11 1111 1111 1111", "card", "4l11 1111 1111 1111"),
])
def test_disguises(text, kind, found):
    spans = pii.all_spans(text, pii.base_spans(text))[kind]
    assert found in [text[a:b] for a, b in spans]
    assert pii.mask(text) == text.replace(found, f"[{kind}]")


@pytest.mark.parametrize("n", [1, 20, 80, 3000])
def test_disguises_of_any_length(n):
    for shown in (f"{'a' * n} (at) example (dot) com", " dot ".join(["part"] * n) + " (at) ex dot co", f"a (at) {' dot '.join(['sub'] * n)} dot com"):
        text = f"write to: {shown} ! now"
        spans = pii.all_spans(text, pii.base_spans(text))["email"]
        assert shown in [text[a:b] for a, b in spans]


@given(st.text(alphabet="ab ", max_size=30), st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4), st.text(alphabet="xy", max_size=3)), max_size=5), st.integers(0, 2))
def test_tape_maps_back_like_a_list(text, cuts, again):
    """Spans against a list that keeps every character's source."""
    tape, spans = pii.Tape(text), [(k, k + 1) for k in range(len(text))]
    for _ in range(again + 1):
        edits, end = [], 0
        for a, n, new in sorted(cuts):
            if a >= end and a + n <= len(tape.text):
                edits.append((a, a + n, new))
                end = a + n
        fresh, at = [], 0
        for a, b, new in edits:
            fresh += spans[at:a] + [(spans[a][0], spans[b - 1][1])] * len(new)
            at = b
        spans = fresh + spans[at:]
        tape = tape.rewrite(edits)
        assert len(tape.text) == len(spans)
        for a in range(len(spans)):
            for b in range(a + 1, len(spans) + 1):
                assert tape.source(a, b) == (spans[a][0], spans[b - 1][1])


def test_long_texts_take_little_memory():
    text = "plain words only " * 200_000 + "john (at) ex (dot) co"
    tracemalloc.start()
    assert len(pii.all_spans(text, pii.base_spans(text))["email"]) == 1
    assert tracemalloc.get_traced_memory()[1] < 16 * len(text)
    tracemalloc.stop()


@pytest.mark.parametrize("text", ["meet me at example.com", "one two three go", "a b at c d dot e", "in at the end. dot", "version 1.2.3", "10l 5O"])
def test_prose_is_left_alone(text):
    assert not any(pii.all_spans(text, pii.base_spans(text)).values())


def test_clean_documents_get_no_added_spans(docs):
    for row in docs.collect():
        base = pii.base_spans(row.text)
        assert pii.all_spans(row.text, base) == base


def test_pii_table(odd_docs, no_docs, docs):
    for frame in (odd_docs, docs):
        texts = sorted(((str(r.doc_id), r.text or "") for r in frame.collect()))
        got = sorted(pii.find(frame).collect(), key=lambda r: str(r.doc_id))
        for (doc_id, text), r in zip(texts, got, strict=True):
            base = brute_spans(text)
            shown = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
            assert (doc_id, hashlib.sha256(shown.encode()).hexdigest()) == (str(r.doc_id), r.base_sha256)
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
    assert pii.find(no_docs).count() == 0
    masked = pii.masked(odd_docs)
    assert masked.columns == odd_docs.columns and masked.filter("text like '%[email]%'").count() == 2


def test_long_texts_take_linear_time():
    for text in ("1" * 100_000, "a." * 50_000, "+1" + "(" * 50_000, "one " * 25_000, "1l" * 25_000, "a (at) " * 20_000):
        pii.all_spans(text, pii.base_spans(text))


# pages


def test_pages_equal_articles(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        start, end = r.html.index("<article>") + 9, r.html.find("</article>")
        body = r.html[start : end if end >= 0 else len(r.html)]
        body = body if end >= 0 else re.sub(r"<[^>]*\Z", "", body)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(filter(None, blocks))
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


WORDS = "word " * 30
PAGE = (
    "<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
    "<div class='cookie-notice'>We use cookies</div>{}<div id=comments><p>" + WORDS + "</p></div><footer>foot</footer></body></html>"
)


def test_marked_article():
    page = PAGE.format("<main><article><header><h1>T &amp; U</h1></header><p>One <b>two</b>\n three<br>four<ul><li>a<li>b</ul><aside>x</aside><form>y</form><p>Last&nbsp;&#233; a < b</article></main>")
    assert H.main_text(page) == "T & U\nOne two three four\na\nb\nLast é a < b"


def test_unmarked_page_by_density():
    page = PAGE.format(f"<div><h2>Head</h2><p>{WORDS}</p><p>short</p><p>{WORDS}end</p></div><div class=sidebar>{WORDS}</div>")
    assert H.main_text(page).split("\n") == ["Head", WORDS.strip(), "short", f"{WORDS}end"]
    assert H.main_text(PAGE.format("")) == ""


def test_marks_hardly_matter(spark):
    """Density finds the same lines with and without the article tags."""
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    same = [H.main_text(page) == H.main_text(re.sub("</?article>", "", page)) for page in rows]
    assert sum(same) >= 0.9 * len(rows)


def brute_text(found, window, surge):
    """Stretches by walking over the lines, then what their main container holds besides."""
    total = sum(own if inside or 2 * own >= len(t) else 0 for t, own, inside in [(t, len(t) if i else o, i) for t, o, i, _ in found])
    within = sum(len(t) for t, _, inside, _ in found if inside)
    rest = max(0.01, 1 - within / max(1, total))
    weight = [len(t) / rest if inside else (own * rest if 2 * own >= len(t) else 0) for t, own, inside, _ in found]
    sums = [sum(weight[k : k + window]) for k in range(len(found))]
    threshold, out, held, surged = min(surge, max(sums) / 4), set(), [], False
    for k in range(len(found)):
        if sums[k] <= 0:
            out |= set(held) if surged else set()
            held, surged = [], False
        elif held or weight[k]:
            held.append(k)
            surged |= sums[k] > threshold
    out |= set(held) if surged else set()
    share = lambda c: sum(weight[k] for k in out if found[k][3] == c)
    main = [c for c in {line[3] for line in found} - {0} if share(c) > 0 and 2 * share(c) >= sum(weight[k] for k in out)]
    for c in main:
        inside = [k for k, line in enumerate(found) if line[3] == c]
        counting = [k for k in inside if weight[k] > 0]
        out |= {k for k in inside if counting[0] <= k <= counting[-1]}
    return "\n".join(found[k][0] for k in sorted(out) if found[k][0])


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "ab", "word " * 9, "long " * 40, "|"]), st.booleans(), st.booleans()), min_size=1, max_size=25), st.integers(1, 5))
def test_line_blocks_equal_brute_force(rows, window):
    tag = {True: "<a href=x>{}</a>", False: "{}"}
    kinds = {"": "<nav>x</nav>", "|": "</div><div>"}
    page = "".join(kinds.get(t) or (f"<article><p>{tag[link].format(t)}</p></article>" if marked else f"<p>{tag[link].format(t)}</p>") for t, link, marked in rows)
    found = H.lines(f"<div>{page}</div>", window)
    assert H.main_text(f"<div>{page}</div>", window) == (brute_text(found, window, 86) if found else "")


def test_marks_are_evidence_only():
    body = "".join(f"<p>{WORDS}{k}</p>" for k in range(9))
    teaser = f"<article><a href=/x>Read next</a></article><div class=x9>{body}</div>"
    assert H.main_text(teaser) == "\n".join(f"{WORDS}{k}" for k in range(9))
    junk = f"<div class=x9><p>{WORDS}</p></div><article>{body}</article>"
    assert H.main_text(junk) == "\n".join(f"{WORDS}{k}" for k in range(9))
    assert H.main_text("<div><p>Short article body here.</p></div>") == "Short article body here."
    assert H.main_text(f"<article><p>{WORDS}</p><aside>no</aside><p>x</p></article>") == f"{WORDS.strip()}\nx"


def test_deep_nesting_takes_linear_time():
    assert H.main_text("<div>" * 50_000 + "text" + "</section>" * 50_000) == "text"
    assert H.main_text("<p>a</p><nav></nav>" * 20_000).count("a") > 0


@pytest.mark.parametrize("page", [None, "", "<", "<article", "<!-- x", "<script>x", "text only", "<article></article>", "<p " + "a='" * 50, "<a" * 2000])
def test_broken_pages(page):
    assert isinstance(H.main_text(page), str)


def test_page_table_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article>a</article>"), (2, "u", "<article>" + "b" * 200_000)], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.n_chars) for r in H.extract(rows.withColumn("text", F.lit("clash"))).collect())
    assert got == [("1", 0), ("1", 0), ("2", 200_000), ("None", 1)]
    assert H.extract(rows.filter("false")).count() == 0


# decontamination


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=15))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert D.common_subsequence([x.encode() for x in a], [y.encode() for y in b]) == table[-1][-1]


@settings(deadline=None)
@given(st.lists(st.none() | st.text("aB9 -\u00e4\u4e2d\n\x00", max_size=60), max_size=8), st.sampled_from([1, 20, 1 << 18]))
def test_words_hashed_together_are_the_words_hashed_alone(texts, room):
    got = []
    for shown, at, ends in D.slabs(pa.array(texts, pa.string()), 20, room):
        assert len(shown) == len(ends) and ends[-1] == len(at)
        got += [part.tolist() for part in np.split(at, ends[:-1])]
    assert got == [[int(D.buckets([w], 20)[0]) for w in D.words_of(t)] for t in texts]


def test_buckets_tell_words_apart():
    words = [("a" * n + str(k)).encode() for n in (0, 3, 8, 15, 30, 59, 64, 500) for k in range(2000)]
    assert len(set(D.buckets(words, 40).tolist())) == len(words)
    assert len(D.buckets([b"x" * 50_000_000], 40)) == 1  # at once, though it has no blank


def _passages(rng, size=400, n=300):
    """Words of passages, frequent and rare ones and some that have no row (size), and where each passage ends."""
    at = np.minimum(rng.zipf(1.3, 40 * n) - 1, size)
    return at, np.sort(rng.choice(np.arange(1, len(at)), n - 1, replace=False)).tolist() + [len(at)]


def test_product_is_that_of_the_matrices():
    rng = np.random.default_rng(3)
    at, ends = _passages(rng)
    idf, x = rng.random(400).astype(np.float32) + 0.1, (rng.integers(0, 30, (400, 4)), rng.choice(np.array([-1.0, 1.0]), (400, 4)))
    dense, a = np.zeros((400, 30)), np.zeros((300, 401))
    np.add.at(dense, (np.arange(400)[:, None], x[0]), x[1])
    np.add.at(a, (np.searchsorted(ends, np.arange(len(at)), side="right"), at), 1)
    a = a[:, :400] * idf
    a *= 0.5 / np.maximum(np.sqrt((a**2).sum(axis=1)), 1e-9)[:, None]
    out = np.ones((400, 30), dtype=np.float32)
    D._product(at, np.array(ends), 0.5, idf, x, out)
    assert np.allclose(out, 1 + a.T @ (a @ dense), atol=1e-4)


def test_windows_of_many_texts_are_those_of_each():
    """Near windows found in a slab of texts against every window on its own, without bounds."""
    rng = np.random.default_rng(8)
    p, known = D.Params(), [f"w{k}".encode() for k in range(500)]
    items = [D.Item(k, [known[j] for j in rng.integers(0, 500, n)], []) for k, n in enumerate((6, 9, 14, 23, 31, 40, 17, 12, 28, 50))]
    texts = [b" ".join([known[j] for j in rng.integers(0, 500, n)] + items[k % 10].words[: 3 + k]) for k, n in enumerate((0, 2, 9, 40, 77, 150, 5, 60, 0, 33, 90, 1) * 4)]
    texts[8:8] = [b"", b"w1 w2"]
    df = rng.integers(0, 30, 1 << p.bits)
    idf, at = D.weights(df, 60), [D.buckets(i.words, p.bits) for i in items]
    slot = D.slots(at, df, idf, D.Params(vocabulary=600))
    space = np.linalg.qr(rng.normal(size=(int(slot.max()), 40)))[0].astype(np.float32)
    one = D.Searcher(items, space, slot, idf, p)
    want = {}
    for t, text in enumerate(texts):
        words = text.split()
        own = D.buckets(words, p.bits)
        for size in one.windows if len(words) >= p.least_words else ():
            for start in range(0, max(1, len(words) - size // 2), max(1, size // 2)):
                part = own[start : start + size]
                cosines = one.vectors @ one.space[slot[part]].sum(axis=0) / np.sqrt((idf[part].astype(float) ** 2).sum())
                for k in np.flatnonzero(cosines >= p.cosine).tolist():
                    if sum(w in words for w in items[k].words) >= p.paraphrase * len(items[k].words):
                        key = t, k, start // len(items[k].words)
                        want[key] = max(want.get(key, 0.0), float(cosines[k]))
    own, ends = D._hashed(texts, p.bits)
    energy = np.r_[0, np.cumsum(idf[own].astype(float) ** 2)]
    got = {(t, k, where): cosine for t, places in one.candidates(slot[own], ends, energy) for k, where, cosine in places}
    assert len(want) > 20 and got == pytest.approx(want, abs=1e-4)


def test_sums_of_rare_terms_stay_in_the_cache():
    """The product makes little beside what it reads: rows of rare terms are not copied all at once, which took most of its time."""
    rng = np.random.default_rng(6)
    at, ends = rng.permutation(np.repeat(np.arange(16_384), 3)), np.arange(48, 49_153, 48)
    x = rng.integers(0, 240, (16_384, 4)), rng.choice(np.array([-1.0, 1.0]), (16_384, 4))
    out, idf = np.zeros((16_384, 240), dtype=np.float32), rng.random(16_384).astype(np.float32) + 0.1
    tracemalloc.start()
    D._product(at, ends, 1.0, idf, x, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < out.nbytes


def test_frequencies_travel_in_slices(spark, monkeypatch):
    """A task sends its counts as at most 65 rows, not a row for every bucket; the counts are those of a plain loop."""
    texts = [" ".join(f"w{k * j % 7919}" for j in range(3000)) for k in range(1, 4)] + [None, "", "w1 w1 W1"]
    sent, summed = [], D._summed
    monkeypatch.setattr(D, "_summed", lambda rows, part: sent.append(rows.count()) or summed(rows, part))
    df, n = D.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), D.Params())
    want = np.zeros(1 << 20, dtype=np.int64)
    for text in texts:
        want[np.unique(D.buckets(D.words_of(text), 20))] += 1
    assert n == 6 and (df == want).all()
    assert 0 < sent[0] <= 65


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of random words; some hold an item whole, in other letters, or with every eighth word changed."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(3000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    items = [text(n) for n in (12, 20, 35, 60, 28, 16)]
    rows, want = [(k, " ".join(text(150))) for k in range(60)], set()
    for k, item in enumerate(items):
        changed = [w if j % 8 else "other" for j, w in enumerate(item, 1)]
        for j, shown in enumerate((" ".join(item), ", ".join(item).upper(), " ".join(changed))):
            rows.append((100 + 10 * k + j, " ".join(text(70)) + " " + shown + " " + " ".join(text(40))))
            want.add((100 + 10 * k + j, k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"), want


@pytest.mark.parametrize("block", [256, 2])
def test_planted_items_are_found(planted, block):
    docs, items, want = planted
    found = {(r.doc_id, r.item_id) for r in D.matches(docs, items, D.Params(block_items=block)).collect()}
    assert found == want
    kept = {r.doc_id for r in D.clean(docs, items).collect()}
    assert kept == set(range(60))


def test_every_document_counts_in_the_latent_space(spark):
    """Words in another order leave all frequencies and change a document's passages: each must change the space."""
    texts = [" ".join(f"d{k}w{j}" for j in range(60)) for k in range(4)]
    items = spark.createDataFrame([(1, " ".join(f"d{k}w{j}" for k in range(4) for j in (3, 50)))], "item_id long, text string")

    def space(rows):
        frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        return next(D.prepared(frame, items, D.Params(sample_docs=2), True)).value.searchers[0].space

    base = space(texts)
    assert np.allclose(base, space(texts), atol=1e-4)
    for k in range(4):
        moved = texts[:k] + [" ".join(reversed(texts[k].split()))] + texts[k + 1 :]
        assert not np.allclose(base, space(moved), atol=1e-3)


def test_items_of_the_tables(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " " + " ".join(w.decode() for w in D.words_of(t)) + " "
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    assert {(r.doc_id, r.item_id) for r in D.matches(docs, items).collect()} == want


def test_items_in_a_third_of_the_rows(spark):
    """An item all of whose words stand in a third of the documents is still found, amid other words, and so in tiny tables."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [text(30), text(55)]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for n in (300, 9):
        held = {k: items[k // 3 % 2] for k in range(0, n, 3)}
        rows = [(k, f"{text(40 + k % 31)} {held.get(k, '')} {text(60)}") for k in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(r.doc_id, r.item_id) for r in D.matches(docs, frame).collect()} == {(k, k // 3 % 2) for k in held}
        assert {r.doc_id for r in D.clean(docs, frame).collect()} == set(range(n)) - set(held)


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while seven wizards"), (2, None), (None, "x y z"), (3, ""), (4, "too short")], "item_id long, text string")
    assert {r.doc_id for r in D.matches(odd_docs, items).collect()} == {1, 2, 3}
    kept = D.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == 8
    assert D.matches(no_docs, items).count() == 0 and D.clean(no_docs, items).count() == 0
    assert D.clean(odd_docs, items.filter("false")).count() == 11


def test_short_items_are_found_word_by_word(spark, docs):
    items = spark.createDataFrame([(1, "the quick brown"), (2, "Fox!"), (3, "")], "item_id long, text string")
    rows = [(1, "see The, quick brown end"), (2, "the quick red brown"), (3, "a fox"), (4, "foxes"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in D.matches(frame, items).collect()} == {(1, 1, "exact"), (3, 2, "exact")}
    assert D.clean(frame, items).count() == 5


@pytest.mark.parametrize("joined", [1, 12])
def test_paraphrases_at_document_lengths(spark, docs, joined):
    """Items with a fifth of the words other than the answer's exchanged, in texts of some length."""
    rng = np.random.default_rng(5)
    texts = [r.text for r in docs.filter("lang = 'en' and text is not null").collect() if len(r.text.split()) > 60]
    vocabulary = sorted({w for t in texts for w in t.split()})
    items = [(r.item_id, D.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {w: sum(w.decode() in t.lower() for t in texts) for _, ws in items for w in ws}
    rows, want = [], set()
    for k, (item_id, words) in enumerate(items):
        rare = set(sorted(set(words), key=lambda w: (known[w], w))[: max(3, len(set(words)) // 2)])
        shown = [w.decode() if w in rare or rng.random() < 0.8 else str(rng.choice(vocabulary)) for w in words]
        around = " ".join(rng.choice(texts, joined)).split()
        place = int(rng.integers(len(around)))
        rows.append((k, " ".join(around[:place] + shown + around[place:])))
        want.add((k, item_id))
    found = {(r.doc_id, r.item_id) for r in D.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(want & found) >= 0.9 * len(want)


# toxicity


def toxic_rows(n: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    common, bad = [f"w{k}" for k in range(400)], ["awful", "dreadful", "nasty"]
    rows = []
    for k in range(n):
        words, label = list(rng.choice(common, 60)), int(k % 6 == 0)
        if label:
            for place in rng.integers(0, 60, 2):
                words[place] = str(rng.choice(bad))
        rows.append((k, " ".join(words), label))
    return rows


def test_held_out_accuracy(spark):
    rows = spark.createDataFrame(toxic_rows(900), "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert 0 < len(model) < 1000
    scored = toxicity.score(rows.select("doc_id", "text"), model).join(rows, "doc_id").withColumn("held", toxicity.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    tested = [r for r in scored if r.held]
    right = sum((r.score >= 0.7) == bool(r.toxic) for r in tested)
    assert right / len(tested) > 0.97 and all(0 <= r.score <= 1 for r in scored)


@given(st.lists(st.tuples(st.sets(st.integers(0, 6), min_size=1), st.booleans()), max_size=40), st.sampled_from([0.0, 0.3, 2.0]))
def test_ftrl_equals_plain_steps(rows, l1):
    """The vectorised learner against the published per-coordinate rule."""
    p = toxicity.Params(bits=3, l1=l1, epochs=2)
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - (p.l1 if z[i] > 0 else -p.l1)) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            at, label = [*sorted(rows[k][0]), 8], rows[k][1]
            w = {i: weight(i) for i in at}
            total = max(-35.0, min(35.0, sum(w.values())))
            g = (1 / (1 + np.exp(-total)) - label) * (p.positive_weight if label else 1.0)
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in range(9) if weight(i)}
    got = toxicity.train([(np.array(sorted(at), dtype=np.int32), int(label)) for at, label in rows], p)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_repeated_labelled_rows_count_once(spark):
    rows = spark.createDataFrame(toxic_rows(200), "doc_id long, text string, toxic int")
    repeated = rows.unionByName(rows.filter("doc_id < 30")).unionByName(rows.filter("doc_id = 6"))
    assert toxicity.fit(rows, rows) == toxicity.fit(repeated, repeated)


def test_training_ignores_held_out_labels(spark):
    rows = spark.createDataFrame(toxic_rows(300), "doc_id long, text string, toxic int")
    flipped = rows.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(rows, rows) == toxicity.fit(rows, flipped.select("doc_id", "toxic"))


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame(toxic_rows(300), "doc_id long, text string, toxic int")
    small = toxicity.fit(rows, rows, toxicity.Params(sample_rows=50, l1=0.5))
    assert small != toxicity.fit(rows, rows, toxicity.Params(l1=0.5))


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (77, 1)], "doc_id long, toxic int")
    scored = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(scored) == 11 and all(0 <= r.score <= 1 for r in scored)
    blank = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.filter("false"))).collect()
    assert {r.score for r in blank} == {0.5}
    kept = toxicity.accepted(odd_docs, labels.filter("false"))
    assert kept.columns == odd_docs.columns and kept.count() == 11
    assert toxicity.score(no_docs, {}).count() == 0


# quotations


def test_quote_links(spark):
    rows = [
        (1, 0, "user", "Hello all.\nWhat is the plan?\n\nSecond para here"),
        (1, 1, "assistant", "On Mon, Jan 1, x wrote:\n> hello   ALL.\n> What is the plan?\nThe plan is simple."),
        (1, 2, "user", ">> What is the plan?\n> The plan is simple.\nThanks a lot"),
        (1, 3, "user", "> nobody said this\nok"),
        (1, 4, "user", "> Second para here\n\nyes"),
        (2, 0, "user", None), (None, 1, "u", "> x\ny"), (2, 1, "u", ">Thanks a lot\nz"), (2, 1, "u", ">Thanks a lot\nz"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.reply_turn, r.thread_turn, r.n_quotes, r.n_linked, r.text) for r in quotes.link(frame).collect()}
    assert got[1, 1] == (0, 0, 3, 3, "The plan is simple.")
    assert got[1, 2] == (1, 0, 2, 2, "Thanks a lot")
    assert got[1, 3] == (None, 3, 1, 0, "ok")
    assert got[1, 4] == (0, 0, 1, 1, "yes")
    assert got[2, 0] == (None, 0, 0, 0, "") and got[2, 1] == (None, 1, 1, 0, "z") and got[None, 1][4] == "y"
    assert quotes.link(frame).count() == 9 and quotes.link(frame.filter("false")).count() == 0


def brute_links(rows):
    """reply_turn by comparing every quoted passage with every earlier message."""
    norm = lambda t: " ".join(t.lower().split())

    def own(text):
        kept = [x for x in text.split("\n") if not x.strip().startswith(">")]
        kept = [x for k, x in enumerate(text.split("\n")) if not x.strip().startswith(">") and not (x.startswith("On ") and text.split("\n")[k + 1 : k + 2] and text.split("\n")[k + 1].strip().startswith(">"))]
        return "\n".join(kept)

    out = {}
    for conv, turn, _, text in rows:
        says = {}
        for t2, text2 in sorted((t, x) for c, t, _, x in rows if c == conv and t < turn):
            mine = own(text2)
            for p in (mine, *re.split(r"\n\s*\n", mine), *mine.split("\n")):
                says.setdefault(norm(p), t2)
        runs, last = [], 0
        for x in text.split("\n"):
            level = len(re.match(r"(\s*>)*", x)[0].replace(" ", ""))
            if level:
                if level != last:
                    runs.append((level, []))
                runs[-1][1].append(norm(re.sub(r"^(\s*>)+", "", x)))
            last = level
        passages = {(level, p) for level, lines in runs for p in (" ".join(filter(None, lines)), *lines) if p}
        words = {}
        for level, p in passages:
            if p in says:
                words[level, says[p]] = words.get((level, says[p]), 0) + len(p.split())
        out[conv, turn] = max(words, key=lambda k: (-k[0], words[k], k[1]))[1] if words else None
    return out


def test_random_threads_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for conv in range(25):
        said = []
        for turn in range(int(rng.integers(2, 14))):
            text = "\n".join(" ".join(rng.choice(words, rng.integers(1, 5))) for _ in range(rng.integers(1, 4)))
            whole = text
            if said and rng.random() < 0.8:
                quoted = said[int(rng.integers(len(said)))]
                lines = quoted.split("\n")
                part = lines if rng.random() < 0.5 else [str(rng.choice(lines))]
                head = f"On {'some long day ' * int(rng.integers(1, 40))} x wrote:\n" if rng.random() < 0.5 else ""
                whole = head + "\n".join(f"> {x.upper()}" for x in part) + "\n" + text
            said.append(whole)
            rows.append((conv, turn, "user", whole))
    got = {(r.conv_id, r.turn): r.reply_turn for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == brute_links(rows) and sum(v is not None for v in got.values()) > 50


def test_conversations_are_in_reading_order(spark):
    rows = [(1, 0, "u", "first thing"), (1, 1, "u", "second thing"), (1, 2, "u", "> first thing\nreply a"), (1, 3, "u", "> second thing\nreply b"), (1, 4, "u", "Am Montag schrieb x:\n> reply a\nend")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.turn, r.thread_turn, r.text) for r in quotes.conversations(frame).collect()]
    assert got == [(0, 0, "first thing"), (2, 0, "reply a"), (4, 0, "end"), (1, 1, "second thing"), (3, 1, "reply b")]


def test_very_long_message(spark):
    rows = [(1, 0, "u", "\n".join(f"line {k}" for k in range(4000))), (1, 1, "u", "\n".join(f"{'>' * (1 + k % 2)} line {k}" for k in range(4000)) + "\nok")]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].reply_turn, got[1].n_linked, got[1].text) == (0, 4000, "ok")


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "message number 0")] + [(1, k, "user", f"> message number {k - 1}\nmessage number {k}") for k in range(1, 40)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.thread_turn for r in got} == {0} and all(r.reply_turn == (r.turn - 1 if r.turn else None) for r in got)


def test_conversations_without_quotes_stay(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = quotes.link(rows)
    assert got.select("conv_id", "turn", "role", "text").exceptAll(rows.select("conv_id", "turn", "role", "text")).count() == 0


def _paragraph(words, word="word"):
    return "<p>" + " ".join([word] * words) + ".</p>"


@pytest.mark.parametrize("between", ["<aside>buy this now</aside>", "<div class='advert'><p>buy this now</p></div>", "<form><input><p>write to us</p></form>"])
def test_a_short_end_after_something_dropped_stays(between):
    from kvarn.llm.html_text import main_text

    body = f"<h1>Told</h1>{_paragraph(60)}{_paragraph(50)}{between}<p>It ended well.</p>"
    outside = "<nav><a href=a>home</a></nav>{}<p>All rights reserved.</p><footer><p>imprint</p></footer>"
    texts = [H.main_text(f"<body>{outside.format(f'<{tag}>{body}</{tag}>')}</body>") for tag in ("div", "section", "article")]
    assert len(set(texts[:2])) == 1 and texts[0].endswith("word.\nIt ended well.") and texts[0].startswith("Told\nword")
    assert texts[2] == texts[0]


def test_a_list_of_links_inside_the_text_stays_and_one_after_it_goes():
    from kvarn.llm.html_text import main_text

    links = "<ul>" + "".join(f"<li><a href=x>see part {k}</a></li>" for k in range(4)) + "</ul>"
    page = f"<body><div>{_paragraph(70)}{_paragraph(60)}{links}<p>The end.</p>{links}</div><div>{links}</div></body>"
    text = H.main_text(page).split("\n")
    assert text[2:] == ["see part 0", "see part 1", "see part 2", "see part 3", "The end."]


def test_lines_of_other_containers_are_not_drawn_in():
    from kvarn.llm.html_text import main_text

    page = f"<body><p>far before</p><nav>x</nav><div>{_paragraph(60)}{_paragraph(50)}</div><nav>x</nav><div><p>far after</p></div></body>"
    assert "far" not in H.main_text(page) and H.main_text(page).count("\n") == 1

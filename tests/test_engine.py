import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from kvarn import embed
from kvarn.api import Knowledge
from kvarn.cli import parser
from kvarn.functions import metadata as M
from kvarn.functions import text as X
from kvarn.operators import search
from kvarn.plans import routing
from kvarn.plans.ingest import Options, ingest
from kvarn.sources import readers
from kvarn.embed import hashed_words
from kvarn.sources.store import ChunkStore, DamagedState, DimensionMismatch
from kvarn.streaming.ingest import sessions, tumbling, watch


def tree(folder, files: dict[str, str]) -> str:
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return str(folder)


@pytest.fixture
def corpus(tmp_path):
    return tree(tmp_path / "src", {"nms/a.md": "# A\n## Vlan\nvlan setup with snmp", "nms/b.md": "# B\n## Other\nplain words only", "build/x.md": "# skip"})


OPTIONS = Options(mode="domain", domain="nms", retry_wait=0.0)


def test_ingest_skips_updates_and_deletes(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    first = ingest(spark, store, corpus, OPTIONS)
    assert (first["files_processed"], first["errors"]) == (2, 0) and first["collection"] == "nms_domain"
    assert first["concepts_found"] == ["snmp_polling", "vlan"]
    assert ingest(spark, store, corpus, OPTIONS)["files_processed"] == 0
    tree(tmp_path / "src", {"nms/a.md": "# A\n## Vlan\nnew text"})
    again = ingest(spark, store, corpus, OPTIONS)
    assert (again["files_processed"], again["chunks_deleted_stale"]) == (1, 1)
    os.remove(tmp_path / "src/nms/b.md")
    gone = ingest(spark, store, corpus, Options(**{**vars(OPTIONS), "clean_stale": True}))
    assert gone["chunks_deleted_stale"] >= 1
    left = {r.source.rpartition("/")[2] for r in ChunkStore(spark, store).chunks().collect()}
    assert left == {"a.md"}


def test_failed_sources_stay_out(spark, tmp_path):
    folder = tree(tmp_path / "s", {"good.md": "# G\n## S\nfine", "bad.md": "# B\n## S\nFAILME"})

    def make():
        inner = embed.hashed_words(8)

        def call(texts):
            if any("FAILME" in t for t in texts):
                raise OSError("down")
            return inner(texts)

        return call

    store = f"file://{tmp_path}/db"
    record = ingest(spark, store, folder, Options(mode="domain", domain="d", make_embedder=make, retry_wait=0.0))
    assert record["errors"] == 1
    kept = ChunkStore(spark, store)
    assert {r.source.rpartition("/")[2] for r in kept.chunks().collect()} == {"good.md"}
    assert {r.source.rpartition("/")[2] for r in kept.checkpoint("d_domain").collect()} == {"good.md"}


def test_dry_run_writes_nothing(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    assert ingest(spark, store, corpus, Options(mode="domain", domain="nms", dry_run=True))["dry_run"]
    assert ChunkStore(spark, store).chunks().count() == 0


def test_changes_and_heads(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS, head="h1")
    changes = spark.createDataFrame([("nms/b.md", "D")], "path string, op string")
    ingest(spark, store, corpus, OPTIONS, changes, "h2")
    kept = ChunkStore(spark, store)
    assert kept.git_head("nms_domain") == "h2"
    assert not kept.chunks().filter(F.col("source").endswith("b.md")).count()


def test_dimension_check(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    kept = ChunkStore(spark, store)
    assert kept.check_dimension("nms_domain", 64)
    with pytest.raises(DimensionMismatch):
        kept.check_dimension("nms_domain", 8)
    assert not kept.check_dimension("nms_domain", 8, recreate=True)
    assert kept.checkpoint("nms_domain").count() == 0


def test_state_files(spark, tmp_path):
    kept = ChunkStore(spark, f"file://{tmp_path}/db")
    assert kept._put("x.json", {"a": 1}) and not kept._put("x.json", {"a": 2})
    assert kept.read_json("x.json", None) == {"a": 1}
    (tmp_path / "db/y.json").write_text("{broken")
    assert kept.read_json("y.json", {}) == {}
    kept.migrate_checkpoint({"s": "m"}, "c")
    assert [tuple(r) for r in kept.checkpoint("c").collect()] == [("s", "m")]


def test_api_search(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    know = Knowledge(spark, store)
    best = know.search_knowledge("vlan setup snmp", "nms", k=1, hybrid=False).first()
    assert "vlan setup" in best["text"]
    assert know.search_concepts("VLAN").count() == 1
    assert "vlan setup" in know.markdown(know.search_knowledge("vlan setup snmp", k=2))
    assert know.feed_domain_doc("notes/n.md", "# N\n## X\nfed text", "nms")["files_processed"] == 1
    assert {r.collection for r in know.get_db_stats()["collections"].collect()} == {"nms_domain"}
    assert know.list_repositories().count() >= 1
    assert know.search_codebase("vlan").count() == 0


def test_stream_ingest(spark, tmp_path, corpus):
    store, mark = f"file://{tmp_path}/db", f"{tmp_path}/ck"
    for _ in range(2):
        query = watch(spark, corpus, store, mark, OPTIONS)
        query.awaitTermination()
    assert ChunkStore(spark, store).chunks().count() >= 2


def test_event_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ev")
    query = tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == rows.count()
    assert sessions(rows).agg(F.sum("n")).first()[0] == rows.count()


def bm25_corpus(spark):
    return spark.createDataFrame([("c", "a", "plain words here", "r1"), ("c", "b", "special token inside", "r2"), ("c", "d", "other words", "r1")],
                                 "collection string, sid string, text string, repository string")


def test_bm25_and_repository_filter(spark):
    rows = bm25_corpus(spark)
    index = search.Bm25Index.build(rows)
    assert index.search("special token", 3).orderBy("bm25_rank").first()["sid"] == "b"
    assert "b" not in {r.sid for r in index.search("special token", 3, rows.filter("repository = 'r1'")).collect()}
    assert index.search("", 3).count() == 0
    assert index.search("zzz", 2).count() == 2


def test_index_is_kept(spark, tmp_path):
    index = search.Bm25Index.build(bm25_corpus(spark))
    index.save(f"{tmp_path}/ix")
    again = search.Bm25Index.load(spark, f"{tmp_path}/ix")
    assert {tuple(r) for r in again.scores("words").collect()} == {tuple(r) for r in index.scores("words").collect()}


def test_sparse_term_breaks_dense_tie(spark):
    rows = bm25_corpus(spark).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4))
    best = search.hybrid(rows, search.Bm25Index.build(rows), "special", [1.0] * 4, 1).first()
    assert best["sid"] == "b"


def test_fusion_order(spark):
    lists = [spark.createDataFrame([("c", s, k) for k, s in enumerate(ids, 1)], "collection string, sid string, r int") for ids in (["a", "b", "c"], ["c", "a"])]
    got = {r.sid: r.rrf for r in search.fuse([(x, "r") for x in lists]).collect()}
    assert got["a"] > got["c"] > got["b"]


def test_routing_scalars():
    assert routing.resolve_collection("code", "nms") == "nms_code" and routing.resolve_collection("rfc", "x", "own") == "own"
    assert [routing.clamp_k(k) for k in (0, 30, "x", "7")] == [1, 25, 5, 7]
    assert (routing.candidate_cap(5), routing.candidate_cap(20), routing.candidate_cap(5, "9")) == (40, 80, 9)
    assert routing.detect_model(None, None, 1024) == "mxbai-embed-large" and routing.detect_model("m", None, 1) == "m"
    assert routing.route_mentions({"docs"}, "auto") == "domain"


def test_rfc_list(spark):
    assert [r.rfc for r in readers.rfc_numbers(spark, " 5 3-4,3,").collect()] == [3, 4, 5]
    assert readers.rfc_numbers(spark, "").count() == 0
    with pytest.raises(Exception, match="reversed range 9-3"):
        readers.rfc_numbers(spark, "9-3").collect()


def test_redaction_is_stable(spark):
    rows = spark.createDataFrame([("call 555-123-4567 at 10.0.0.1/24, a@b.co, 00:11:22:33:44:55, host.example.com é",)], "t string")
    once = rows.select(X.sanitize(F.col("t")).alias("t"))
    assert once.first()[0] == "call [phone] at x.x.x.x, [email], [mac], [hostname] é"
    assert once.select(X.sanitize(F.col("t"))).first()[0] == once.first()[0]


def test_concept_join(spark):
    rows = spark.createDataFrame([("1", "nms", "a vlan"), ("2", "x", "vlan")], "chunk_id string, domain string, text string")
    registry = spark.createDataFrame([("nms", "VLAN", "vlan")], "domain string, keyword string, concept string")
    assert {r.chunk_id: r.concepts for r in M.concepts_by_join(rows, registry).collect()} == {"1": ["vlan"], "2": None}


def test_retry_halves_batches():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise OSError
        return [[1.0]] * len(texts)

    assert embed.with_retry(call, ["a", "bad", "c", "d"], tries=2, wait=0) == [[1.0], None, [1.0], [1.0]]


def test_paged_source(spark):
    def fetch(start, size):
        return [(str(k), json.dumps({"n": k})) for k in range(start, min(start + size, 5))]

    class Fixture(readers.Pages):
        @classmethod
        def name(cls):
            return "fixture_pages"

    Fixture.fetch = staticmethod(fetch)
    spark.dataSource.register(Fixture)
    rows = spark.read.format("fixture_pages").option("total", 5).option("page_size", 2).load()
    assert sorted(r.id for r in rows.collect()) == ["0", "1", "2", "3", "4"]


def test_csv_and_page_filters(spark, tmp_path):
    (tmp_path / "t.csv").write_text("FormattedID , Description\nUS1,\n")
    assert [tuple(r) for r in readers.csv_tickets(spark, f"{tmp_path}/t.csv").collect()] == [("US1", "")]
    pages = spark.createDataFrame([("current", "x" * 200, "a,b"), ("archived", "x" * 200, "a"), (None, "short", "a")], "status string, body string, labels string")
    assert readers.page_filter(pages, "b").count() == 1
    tickets = spark.createDataFrame([({"Severity": "2 - High", "Description": "d", "Tags": ""},), ({"Severity": "4", "Description": "d"},), ({"Description": " "},),
                                     ({"Description": "d", "Tags": "Duplicate"},)], "ticket map<string,string>")
    assert tickets.filter(readers.ticket_api_filter(F.col("ticket"))).count() == 1


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary")
    assert [r[0] for r in rows.select(X.decode(F.col("b"))).collect()] == ["é", "é"]


def test_command_line():
    args = parser().parse_args(["query", "x", "--mode", "concept", "-k", "3"])
    assert (args.command, args.mode, args.k) == ("query", "concept", "3")
    with pytest.raises(SystemExit):
        parser().parse_args(["query", "--mode", "odd"])


def test_fuzzy_hint(spark):
    rows = spark.createDataFrame([("a\ndef f(x):\n  return x\nb", "def f(y):\n  return y"), ("nothing alike", "zzzz"), (None, "x")], "t string, w string")
    assert [r[0] for r in rows.select(X.fuzzy_hint("t", "w")).collect()] == ["def f(x):\n  return x", None, None]


def test_pages_and_listings(spark):
    rows = spark.createDataFrame([("b", False), ("A", False), ("z", True)], "name string, is_dir boolean")
    assert [r.name for r in readers.listing(rows).collect()] == ["z", "A", "b"]
    text = spark.createDataFrame([("Network Working Group " + "x" * 300,), ("<html> rfc " + "x" * 300,), ("rfc 1",)], "t string")
    assert [r[0] for r in text.select(X.looks_like_rfc(F.col("t"))).collect()] == [True, False, False]
    assert X.markdown_targets("mxbai-embed-large") == (682, 2048) and X.rfc_targets("nomic-embed-text") == (10922, 32768)


def test_render_types(spark):
    from kvarn.operators import render

    rows = spark.createDataFrame([
        (1, "code", "x ``` y", {"repository": "r", "relative_path": "a.py", "chunk_name": "f", "chunk_type": "function", "extension": ".py", "dependencies": "os"}),
        (2, "rfc", "t", {"rfc_number": "1", "section_number": "2", "section_title": "S"}), (3, "customer", "t", {"ticket_id": "T", "has_resolution": "true"}),
        (4, "mib", "t", {"object_name": "o", "oid_path": "p"}), (5, "community", "t", {}), (6, "other", "t", {}),
    ], "id int, source_type string, text string, metadata map<string,string>").withColumn("collection", F.lit("c"))
    got = {r.id: r.shown for r in rows.select("id", render.result().alias("shown")).collect()}
    assert got[1].endswith("~~~python\nx ``` y\n~~~") and "**File:** r/a.py" in got[1] and "**Component:** f (function)" in got[1]
    assert got[2] == "### RFC 1 §2: S\n\nt" and got[3] == "### [T] — Resolution: (see body)\n\nt"
    assert got[4] == "### OID: o (p) — Description\n\nt" and got[5].startswith("### Source: [unknown]") and got[6].startswith("### Result")
    assert render.joined(rows.filter("false"), render.result(), "id").first()[0] == "No matching chunks found."
    answer = json.loads(render.as_json(rows, 'q "x"', "semantic", "id").first()[0])
    assert answer["query"] == 'q "x"' and len(answer["results"]) == 6
    assert render.by_type(rows, "id").count() == 6
    assert rows.select(render.compact().alias("c")).first()["c"].startswith("[code] (c)\na.py\n")


# what a crash, a suffix or a ticket must not do


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path, corpus):
    """A crash between writing chunks and the commit leaves the version before; a damaged version is an error."""
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    kept = ChunkStore(spark, store)
    n = kept.chunks().count()
    assert n

    class Crash(ChunkStore):
        def commit(self, change):
            raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        Crash(spark, store).delete_sources("nms_domain", kept.chunks().select("source"))
    assert ChunkStore(spark, store).chunks().count() == n
    assert kept.vacuum() == 0 and kept.vacuum(grace=0) == 1 and kept.chunks().count() == n
    (tmp_path / "db" / "versions" / f"{kept.state()['version']:012d}.json").write_text("{")
    with pytest.raises(DamagedState):
        ChunkStore(spark, store).chunks()


def test_a_write_keeps_other_collections_as_they_are(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    before = ChunkStore(spark, store).state()["collections"]
    ingest(spark, store, corpus, Options(mode="theory", domain="nms", retry_wait=0.0))
    after = ChunkStore(spark, store).state()["collections"]
    assert after["nms_domain"] == before["nms_domain"] and "theory" in after


def test_deleted_path_is_no_suffix(spark, tmp_path):
    folder, store = tmp_path / "src", f"file://{tmp_path}/db"
    folder.mkdir()
    for name in ("b.py", "lib_b.py"):
        (folder / name).write_text(f"def f():\n    return '{name}'\n")
    options = Options(mode="code", domain="d", retry_wait=0.0)
    ingest(spark, store, str(folder), options)
    (folder / "b.py").unlink()
    ingest(spark, store, str(folder), options, spark.createDataFrame([("b.py", "D")], "path string, op string"))
    assert {r.source.rpartition("/")[2] for r in ChunkStore(spark, store).chunks().collect()} == {"lib_b.py"}


def test_tickets_are_ingested_and_redacted(spark, tmp_path):
    folder, store = tmp_path / "t", f"file://{tmp_path}/db"
    folder.mkdir()
    told = "Box 10.1.2.3 fails, write to jane.doe@corp.example; workaround: reboot"
    (folder / "a.json").write_text(json.dumps([{"FormattedID": "US1", "Name": "n", "Description": told, "Severity": "1", "State": "Closed"},
                                               {"FormattedID": "US2", "Name": "m", "Description": "other", "Severity": "4", "State": "Closed"}]))
    (folder / "b.csv").write_text('FormattedID,Description,Severity,State\nUS3,"told by bob@corp.example, twice",2,closed\nUS4,open one,2,Open\n')
    options = Options(mode="customer", domain="d", retry_wait=0.0, ticket_filter="severity=1,2,3 state=closed")
    ingest(spark, store, str(folder), options)
    rows = ChunkStore(spark, store).chunks().collect()
    assert sorted(r.extra["ticket_id"] for r in rows) == ["US1", "US3"]
    assert not any("@corp" in r.text or "10.1.2.3" in r.text for r in rows)
    assert {r.extra["has_workaround"] for r in rows} == {"true", "false"} and all("rally_id" not in r.extra for r in rows)
    assert sorted(r.source.startswith("csv:") for r in rows) == [False, True]
    ingest(spark, store, str(folder), Options(mode="rally", domain="d", retry_wait=0.0))
    internal = ChunkStore(spark, store).chunks("d_internal").collect()
    assert sorted(r.extra["rally_id"] for r in internal) == ["US1", "US2", "US3", "US4"] and any("@corp" in r.text for r in internal)
    (folder / "b.csv").unlink()
    ingest(spark, store, str(folder), Options(**{**vars(options), "clean_stale": True}))
    assert {r.extra["ticket_id"] for r in ChunkStore(spark, store).chunks("d_customer").collect()} == {"US1"}


def test_other_dimension_is_refused_or_recreated(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    wider = Options(**{**vars(OPTIONS), "make_embedder": lambda: hashed_words(32), "force": True})
    with pytest.raises(DimensionMismatch):
        ingest(spark, store, corpus, wider)
    ingest(spark, store, corpus, Options(**{**vars(wider), "recreate": True}))
    assert {len(r.embedding) for r in ChunkStore(spark, store).chunks("nms_domain").collect()} == {32}


def test_ignore_files_are_discovered(spark, tmp_path):
    folder = tmp_path / "src"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.py", "a.log", "sub/b.py", "sub/c.py"):
        (folder / name).write_text("x = 1\n")
    (folder / ".gitignore").write_text("*.log\n")
    (folder / "sub" / ".gitignore").write_text("b.py\n")
    rules = readers.discover_ignores(spark, str(folder))
    assert rules == {"": ["*.log"], "sub": ["b.py"]}
    found = {r.rel_path for r in readers.scan(spark, str(folder), "domain", rules).collect()}
    assert found == {"a.py", "sub/c.py"}


def test_git_changes(spark, tmp_path):
    def git(*args):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *args], capture_output=True, text=True, check=True).stdout

    git("init", "-q")
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("1")
    git("add", ".")
    git("commit", "-qm", "1")
    first = git("rev-parse", "HEAD").strip()
    (tmp_path / "a.py").write_text("2")
    (tmp_path / "b.py").unlink()
    (tmp_path / "c d.py").write_text("3")
    git("add", "-A")
    git("commit", "-qm", "2")
    changes, head = readers.git_changes(spark, str(tmp_path), first)
    assert {tuple(r) for r in changes.collect()} == {("a.py", "M"), ("b.py", "D"), ("c d.py", "A")} and head != first
    assert readers.git_changes(spark, str(tmp_path), None) == (None, head)
    assert readers.git_changes(spark, str(tmp_path), "0" * 40) == (None, head)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.py").write_text("4")
    git("add", "-A")
    git("commit", "-qm", "3")
    below, _ = readers.git_changes(spark, str(tmp_path / "sub"), first)
    assert {tuple(r) for r in below.collect()} == {("e.py", "A")}


def test_repeated_ids_count_once(spark):
    rows = spark.createDataFrame([("c", 1, "a b"), ("c", 1, "a b"), ("c", 2, "b c")], "collection string, sid int, text string")
    index = search.Bm25Index.build(rows, unique=False)
    assert index.lengths.count() == 2 and {r.tf for r in index.postings.collect()} == {1}
    assert {r.tf for r in search.Bm25Index(index.blocks, index.lengths, index.terms).postings.collect()} == {1}


def test_term_index_is_kept(spark, tmp_path, corpus):
    store = f"file://{tmp_path}/db"
    ingest(spark, store, corpus, OPTIONS)
    known = Knowledge(spark, store)
    first = known.search_knowledge("snmp", "nms").select("sid").collect()
    assert first
    built = search.Bm25Index.build
    search.Bm25Index.build = None
    try:
        assert known.search_knowledge("snmp", "nms").select("sid").collect() == first
    finally:
        search.Bm25Index.build = built

    def broken(texts):
        raise RuntimeError("no embedder")

    assert Knowledge(spark, store, broken).search_knowledge("@docs snmp", "nms").count() > 0

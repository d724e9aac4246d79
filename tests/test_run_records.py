"""Records of runs and of streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from kvarn.plans.ingest import Options, ingest
from kvarn.sources.store import ChunkStore
from kvarn.streaming.ingest import tumbling, watch
from kvarn.streaming.progress import recorded

OPTIONS = Options(mode="domain", domain="nms", retry_wait=0.0, gitignore=False)


def corpus(folder):
    folder.mkdir()
    for name, body in {"a.md": "# A\n## Vlan\nvlan setup with snmp", "b.md": "# B\n## More\nvlan once more", "c.md": "# C\n## Other\nplain"}.items():
        (folder / name).write_text(body)
    return str(folder)


def test_a_store_without_runs(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/none")
    assert store.runs().count() == store.progress().count() == store.tallies().count() == 0


def test_counters_are_those_of_the_stored_chunks(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    first = ingest(spark, folder, corpus(tmp_path / "src"), OPTIONS)
    second = ingest(spark, folder, str(tmp_path / "src"), OPTIONS)
    store = ChunkStore(spark, folder)
    chunks = store.chunks()
    types = {r.content_type: r["count"] for r in chunks.groupBy("content_type").count().collect()}
    concepts = {r.c: r["count"] for r in chunks.select(F.explode("concepts").alias("c")).groupBy("c").count().collect()}
    assert first["content_type_distribution"] == types and first["concepts_found"] == sorted(concepts)
    assert second["content_type_distribution"] == {} and second["concepts_found"] == []
    kept = {(r.kind, r.value): r.n for r in store.tallies().filter(F.col("run_id") == first["ingestion_id"]).collect()}
    assert kept == {**{("content_type", k): n for k, n in types.items()}, **{("concept", k): n for k, n in concepts.items()}}
    runs = {r.ingestion_id: r.asDict() for r in store.runs().collect()}
    assert runs == {r["ingestion_id"]: r for r in (first, second)}


def settle(store, event, n, seconds=30):
    """Listeners are told after the fact."""
    end = time.time() + seconds
    while time.time() < end and store.progress().filter(F.col("event") == event).count() < n:
        time.sleep(0.3)
    return store.progress().filter(F.col("event") == event).collect()


def test_streams_leave_a_record_of_each_batch(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 1000 % 7200).cast("timestamp").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    with recorded(spark, f"file://{tmp_path}/db") as store:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("n"))
        query = tumbling(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        ended = settle(store, "end", 1)
    batches = [r for r in store.progress().collect() if r.event == "batch" and r.input_rows]
    assert sum(r.input_rows for r in batches) == sum(int(r.observed["seen"]["n"]) for r in batches) == 100
    assert len({r.batch_id for r in batches}) == 2 and batches[0].query == "counted" and max(r.state_rows for r in batches) > 0
    assert [r.error for r in ended] == [None]


def test_a_broken_stream_leaves_its_error(spark, tmp_path):
    source = corpus(tmp_path / "src")

    def down():
        raise OSError("no embedder")

    with recorded(spark, f"file://{tmp_path}/db") as store:
        query = watch(spark, source, f"file://{tmp_path}/db", f"{tmp_path}/mark", Options(**{**vars(OPTIONS), "make_embedder": down}))
        with pytest.raises(Exception, match="no embedder"):
            query.awaitTermination(60)
        ended = settle(store, "end", 1)
    assert len(ended) == 1 and "no embedder" in ended[0].error and os.path.isdir(f"{tmp_path}/db/progress")


def test_paths_stay_below_their_root(spark):
    from kvarn.functions.text import safe_path

    given = [" a/b.md ", "/etc/passwd", "a\\..\\b", "..", "a/../../b", "a..b/...", "", None, "./a//b/."]
    rows = spark.createDataFrame(list(enumerate(given)), "k int, p string").select("k", safe_path(F.col("p"), "/w").alias("p"))
    want = ["/w/a/b.md", "/w/etc/passwd", None, None, None, "/w/a..b/...", "/w", None, "/w/a/b"]
    assert [r.p for r in sorted(rows.collect())] == want


def test_notes_are_kept_and_found(spark, tmp_path):
    from kvarn.api import Knowledge

    know = Knowledge(spark, f"file://{tmp_path}/db")
    assert know.notes().count() == 0
    notes = lambda *rows: spark.createDataFrame(rows, "title string, content string")
    record = know.remember(notes(("Trunk ports!", "# Trunk\n## Vlan\nvlan on trunk ports\n"), ("../Other: note", None)), "nms")
    assert record["files_processed"] == 2 and record["collection"] == "nms_domain"
    assert {tuple(r) for r in know.notes().collect()} == {("Trunk_ports", "# Trunk\n## Vlan\nvlan on trunk ports\n"), ("Other_note", "")}
    know.remember(notes(("Trunk ports", "# Trunk\n## Vlan\nrenumbered")), "nms")
    know.remember(notes(("Trunk ports", "# Wiki\n## Page\nof its own")), "nms", "wiki")
    texts = {r.source.rpartition("/memory/")[2]: r.text for r in ChunkStore(spark, f"file://{tmp_path}/db").chunks().collect()}
    assert set(texts) == {"domain_docs/Trunk_ports.md", "wiki/Trunk_ports.md"} and "renumbered" in texts["domain_docs/Trunk_ports.md"]
    assert {r.name for r in know.notes().collect()} == {"Trunk_ports", "Other_note"} and know.notes("wiki").count() == 1
    for bad in (notes(("?!", "x")), notes(("a b", "x"), ("a  b", "y")), notes((None, "x"))):
        with pytest.raises(ValueError, match="name"):
            know.remember(bad)
    with pytest.raises(ValueError, match="storage"):
        know.remember(notes(("a", "x")), storage="../x")

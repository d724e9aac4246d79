"""Sources that are followed page by page, and embedders that are slow or fail."""

import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from kvarn import embed
from kvarn.plans.ingest import Options
from kvarn.sources import readers
from kvarn.sources.store import ChunkStore
from kvarn.streaming.ingest import follow


def page_source(spark, name, rows, log, broken=None, cursor=False):
    """A registered source over rows; its fetches are noted in a folder, the page that starts at `broken` fails once."""

    def fetch(start, size):
        number = int(str(start).lstrip("c"))
        tries = len([f for f in os.listdir(log) if f.startswith(f"{number}-")])
        open(f"{log}/{number}-{tries}", "w").close()
        if number == broken and not tries:
            raise OSError("connection reset")
        page = rows[number : number + size]
        following = number + size if number + size < len(rows) else None
        return (page, f"c{following}" if following else None) if cursor else page

    class Fixture(readers.Pages):
        @classmethod
        def name(cls):
            return name

    Fixture.fetch = staticmethod(fetch)
    spark.dataSource.register(Fixture)


def until_done(query, store, name, n):
    end = time.time() + 120
    while time.time() < end and query.isActive and ChunkStore(query_spark, store).checkpoint(name).count() < n:
        time.sleep(0.5)


query_spark = None


@pytest.mark.parametrize("cursor", [False, True])
def test_a_broken_fetch_goes_on_where_it_stopped(spark, tmp_path, cursor):
    global query_spark
    query_spark = spark
    log = tmp_path / "log"
    log.mkdir()
    body = {"Description": "told", "Severity": "2 - High", "Tags": ""}
    rows = [(f"US{k}", json.dumps({"FormattedID": f"US{k}", "Name": f"n{k}", **body})) for k in range(7)]
    rows[3] = ("US3", json.dumps({"FormattedID": "US3", "Name": "n3", "Description": "d", "Severity": "4"}))
    page_source(spark, f"broken_pages_{cursor}".lower(), rows, str(log), broken=4, cursor=cursor)
    store, mark = f"file://{tmp_path}/db", f"{tmp_path}/mark"
    options = Options(mode="rally", domain="d", retry_wait=0.0)
    start = lambda: follow(spark, f"broken_pages_{cursor}".lower(), store, mark, options, page_size=2)
    first = start()
    with pytest.raises(StreamingQueryException):
        first.awaitTermination(120)
    assert ChunkStore(spark, store).checkpoint("d_internal").count() <= 3
    second = start()
    until_done(second, store, "d_internal", 6)
    second.stop()
    chunks = ChunkStore(spark, store).chunks("d_internal").collect()
    assert sorted(r.extra["rally_id"] for r in chunks) == ["US0", "US1", "US2", "US4", "US5", "US6"]
    fetched = sorted(os.listdir(log))
    assert [f for f in fetched if f.startswith("0-")] == ["0-0"] and len([f for f in fetched if f.startswith("4-")]) >= 2


def test_wiki_pages_become_sources(spark):
    page = {"title": "Home\npage", "space": "S", "labels": "a,b", "status": "current", "url": "https://w/1", "body": "<h1>T</h1>" + "x " * 200}
    rows = spark.createDataFrame([("1", json.dumps(page)), ("2", json.dumps({**page, "url": "", "labels": "b"})), ("3", json.dumps({**page, "status": "archived"})), ("4", "{}")], "id string, payload string")
    got = {r.source: r.text for r in readers.page_sources(rows).collect()}
    assert set(got) == {"https://w/1", "https:page/2"} and got["https://w/1"].startswith("---\npage_title: Home page\nspace: S\n")
    assert [r.source for r in readers.page_sources(rows, "a").collect()] == ["https://w/1"]


def slow_embedder():
    def call(texts):
        time.sleep(0.05)
        if "bad" in texts:
            raise OSError("refused")
        return [[float(len(t))] for t in texts]

    return call


def test_batches_overlap_and_keep_their_order(spark):
    rows = spark.createDataFrame([(k, "bad" if k == 57 else "x" * k) for k in range(320)], "k int, text string").coalesce(1).cache()
    rows.count()

    def run(concurrency):
        began = time.time()
        out = embed.embed_chunks(rows, slow_embedder, batch=4, tries=1, wait=0.0, concurrency=concurrency).collect()
        return time.time() - began, {r.k: r.embedding for r in out}

    run(8)
    (one, slow), (many, fast) = run(1), run(8)
    assert slow == fast == {k: None if k == 57 else [float(k)] for k in range(320)}
    assert one > 4 and many < one / 2
    rows.unpersist()


def test_plain_answers_are_compact(spark, tmp_path):
    from kvarn.api import Knowledge
    from kvarn.plans.ingest import feed

    store = f"file://{tmp_path}/db"
    feed(spark, store, "notes/n.md", "# N\n## X\nfed text", Options(mode="domain", domain="nms", retry_wait=0.0))
    known = Knowledge(spark, store)
    shown = known.plain(ChunkStore(spark, store).chunks().withColumn("sid", F.col("chunk_id")))
    assert shown.startswith("[domain_doc] (nms_domain)") and "fed text" in shown

"""The store of runs: what a write costs, what concurrent writers keep, what reading gives after any history."""

import random
import subprocess
import threading

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from kvarn import cli
from kvarn.plans.ingest import Options, feed, ingest
from kvarn.sources.store import Busy, ChunkStore, Conflict, mergeable, vanished

OPTIONS = Options(mode="domain", domain="d", retry_wait=0.0)


def chunk_rows(spark, rows):
    """rows of (chunk_id, source, text)."""
    return spark.createDataFrame(rows, "chunk_id string, source string, text string").withColumn("chunk_index", F.lit(0))


def held(store, collection):
    return {(r.chunk_id, r.source, r.text) for r in store.chunks(collection).collect()}


def written(folder) -> dict[str, int]:
    """Rows of every Parquet file below a folder."""
    return {str(p): ds.dataset(p, format="parquet").count_rows() for p in folder.rglob("*.parquet")}


def test_feeding_writes_what_it_brings(spark, tmp_path):
    costs = []
    for n in (50, 3000):
        folder = tmp_path / f"db{n}"
        store = ChunkStore(spark, f"file://{folder}")
        store.upsert("d_domain", chunk_rows(spark, [(f"id{k}", f"s{k}", "t") for k in range(n)]), "r0")
        before = written(folder)
        feed(spark, store.folder, "notes/one.md", "# A\n## B\nshort text", OPTIONS)
        feed(spark, store.folder, "notes/one.md", "# A\n## B\nother text", OPTIONS)
        after = written(folder)
        costs.append(sum(rows for name, rows in after.items() if name not in before))
        assert store.chunks("d_domain").count() == n + 1
        assert all(name in after for name in before)
    assert costs[0] == costs[1] <= 8


def test_runs_stay_few_and_contents_right(spark, tmp_path):
    """Upserts, deletions and merges in any order give what a plain dictionary gives."""
    rng = random.Random(4)
    store, want, seen = ChunkStore(spark, f"file://{tmp_path}/db"), {}, {}
    for step in range(14):
        sources = rng.sample("abcdefgh", 2)
        rows = [(f"{s}{k}", s, f"{step}") for s in sources for k in range(rng.randint(1, 4))]
        gone = rng.sample("abcdefgh", 1) if step % 3 == 2 else []
        old = dict(want)
        want = {i: v for i, v in want.items() if v[0] not in sources and v[0] not in gone} | {i: (s, t) for i, s, t in rows}
        counts = store.upsert(
            "c", chunk_rows(spark, rows), f"r{step}", gone=spark.createDataFrame([(g,) for g in gone], "source string"),
            seen=spark.createDataFrame([(s, f"{step}") for s in sources], "source string, md5 string"), forget=spark.createDataFrame([(g,) for g in gone], "source string"),
        )
        seen = {s: m for s, m in seen.items() if s not in gone} | {s: f"{step}" for s in sources}
        fresh = {i for i, _, _ in rows}
        assert (counts.updated, counts.created) == (len(fresh & set(old)), len(fresh - set(old)))
        assert counts.deleted == len([i for i, v in old.items() if i not in fresh and (v[0] in sources or v[0] in gone)])
        if step % 2:
            store.compact("c")
        assert held(store, "c") == {(i, s, t) for i, (s, t) in want.items()}
        assert {tuple(r) for r in store.checkpoint("c").collect()} == set(seen.items())
    assert len(store.state()["collections"]["c"]["runs"]) <= 6
    n = len(held(store, "c"))
    store.vacuum(grace=0)
    assert len(held(store, "c")) == n and len(list((tmp_path / "db" / "versions").glob("*.json"))) == 1


def test_which_runs_are_merged():
    assert mergeable([1000, 1, 1, 1]) == 0 and mergeable([1000, 1, 1, 1, 1]) == 4
    assert mergeable([5, 5, 5, 5]) == 4 and mergeable([1000, 300, 300, 300, 200]) == 5
    sizes, moved = [], 0
    for _ in range(2000):
        sizes.append(1)
        while n := mergeable(sizes):
            moved += sum(sizes[-n:])
            sizes[-n:] = [sum(sizes[-n:])]
    assert len(sizes) < 25 and moved < 2000 * 25


def test_collections_are_merged_apart(spark, tmp_path):
    """The same chunk id in two collections is two chunks."""
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    for name in ("a", "b"):
        store.upsert(name, chunk_rows(spark, [("i", "s", "old")]), "r1")
    store.upsert("a", chunk_rows(spark, [("i", "s", "new")]), "r2")
    assert {(r.collection, r.text) for r in store.chunks().collect()} == {("a", "new"), ("b", "old")}
    assert store.delete_sources("b", spark.createDataFrame([("s",)], "source string")) == 1
    assert {(r.collection, r.text) for r in store.chunks().collect()} == {("a", "new")}


def test_six_writers_keep_six_collections(spark, tmp_path):
    folder, wrong = f"file://{tmp_path}/db", []

    def write(name):
        try:
            for k in range(2):
                ChunkStore(spark, folder).upsert(name, chunk_rows(spark, [(f"{name}{k}", f"s{k}", "t")]), "r", config={name: "x"})
        except Exception as e:  # shown by the assertion below
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(f"c{n}",)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = ChunkStore(spark, folder).state()
    assert not wrong and len(state["collections"]) == 6 == len(state["config"])
    assert ChunkStore(spark, folder).chunks().count() == 12 == state["version"]


def test_writers_of_one_collection(spark, tmp_path):
    """A write that loses is worked out again on what the other has put there."""
    folder = f"file://{tmp_path}/db"
    ChunkStore(spark, folder).upsert("c", chunk_rows(spark, [("i1", "s", "first")]), "r0")

    class Overtaken(ChunkStore):
        passed = False

        def commit(self, change):
            if not self.passed:
                self.passed = True
                ChunkStore(spark, folder).upsert("c", chunk_rows(spark, [("i2", "s", "second"), ("i9", "other", "o")]), "r1")
            return super().commit(change)

    counts = Overtaken(spark, folder).upsert("c", chunk_rows(spark, [("i3", "s", "third")]), "r2")
    assert held(ChunkStore(spark, folder), "c") == {("i3", "s", "third"), ("i9", "other", "o")}
    assert (counts.created, counts.updated, counts.deleted) == (1, 0, 1)

    class Never(ChunkStore):
        def _put(self, name, value):
            return False

    before = held(ChunkStore(spark, folder), "c")
    with pytest.raises(Conflict):
        Never(spark, folder, tries=2).upsert("c", chunk_rows(spark, [("i4", "s", "lost")]), "r3")
    assert held(ChunkStore(spark, folder), "c") == before


def test_one_run_at_a_time(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    with store.hold("c", "one"):
        with pytest.raises(Busy), store.hold("c", "two"):
            pass
        with store.hold("other", "two"):
            pass
    with store.hold("c", "two", seconds=-1), store.hold("c", "three"):
        pass
    with store.hold("c", "four"):
        pass
    assert store.state()["collections"]["c"]["lease"] is None


# --- sources that were not looked for -----------------------------------------------------------------------------


def folder_of(path, files):
    for name, text in files.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
    return str(path)


def names(store, name="d_domain"):
    return {r.source.rpartition("/")[2] for r in store.chunks(name).collect()}


def test_feed_forgets_no_other_source(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    files = folder_of(tmp_path / "a", {f"{n}.md": f"# {n}\n## S\ntext {n}" for n in "xyz"})
    ingest(spark, store.folder, files, OPTIONS)
    feed(spark, store.folder, "notes/n.md", "# N\n## S\nfed", OPTIONS)
    feed(spark, store.folder, "notes/n.md", "# N\n## S\nfed again", Options(**{**vars(OPTIONS), "clean_stale": True}))
    assert names(store) == {"x.md", "y.md", "z.md", "n.md"} and store.checkpoint("d_domain").count() == 4
    assert ingest(spark, store.folder, files, OPTIONS)["files_processed"] == 0


def test_second_folder_keeps_the_first(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/db")
    a = folder_of(tmp_path / "a", {"x.md": "# X\n## S\none", "y.md": "# Y\n## S\ntwo"})
    b = folder_of(tmp_path / "ab", {"z.md": "# Z\n## S\nthree"})
    clean = Options(**{**vars(OPTIONS), "clean_stale": True})
    ingest(spark, store.folder, a, clean)
    ingest(spark, store.folder, b, clean)
    assert names(store) == {"x.md", "y.md", "z.md"}
    (tmp_path / "a" / "x.md").unlink()
    record = ingest(spark, store.folder, a, clean)
    assert record["chunks_deleted_stale"] == 1 and names(store) == {"y.md", "z.md"}
    assert {r.source.rpartition("/")[2] for r in store.checkpoint("d_domain").collect()} == {"y.md", "z.md"}


def test_vanished_is_bounded_by_its_root(spark):
    seen = spark.createDataFrame([(s,) for s in ("a/1", "a/2", "ab/1", "csv:a/t.csv:9", "csv:b/t.csv:9", "rally:1", "https://x/y")], "source string")
    there = spark.createDataFrame([("a/2",)], "source string")
    gone = lambda root: {r.source for r in vanished(seen, there, root).collect()}
    assert gone("a") == gone("a/") == {"a/1", "csv:a/t.csv:9"}
    assert gone(None) == set() and gone("") == {"a/1", "ab/1", "csv:a/t.csv:9", "csv:b/t.csv:9"}


def test_incremental_run_in_a_subfolder(spark, tmp_path, monkeypatch):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path / "repo"), "-c", "user.name=x", "-c", "user.email=x@y", *args], capture_output=True, check=True)

    sub = folder_of(tmp_path / "repo" / "docs", {"a.md": "# A\n## S\none", "b.md": "# B\n## S\ntwo"})
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "1")
    monkeypatch.setattr(cli.session, "build", lambda: spark)
    run = lambda: cli.main(["--db-path", f"file://{tmp_path}/db", "ingest", sub, "--mode", "domain", "--domain", "d", "--incremental", "--retry-wait", "0"])
    assert run() == 0
    (tmp_path / "repo" / "docs" / "a.md").write_text("# A\n## S\nnew words")
    (tmp_path / "repo" / "docs" / "b.md").unlink()
    git("add", "-A")
    git("commit", "-qm", "2")
    assert run() == 0
    assert [r.text for r in ChunkStore(spark, f"file://{tmp_path}/db").chunks("d_domain").collect()][0].endswith("new words")
    assert names(ChunkStore(spark, f"file://{tmp_path}/db")) == {"a.md"}


def test_model_follows_the_stored_length(spark, tmp_path):
    from kvarn.embed import hashed_words

    store = ChunkStore(spark, f"file://{tmp_path}/db")
    wide = Options(**{**vars(OPTIONS), "make_embedder": lambda: hashed_words(1024)})
    files = folder_of(tmp_path / "a", {"x.md": "# X\n## S\none"})
    ingest(spark, store.folder, files, wide)

    def forget(state):
        state["config"] = {}
        return state

    store.commit(forget)
    assert ingest(spark, store.folder, files, wide)["embedding_model"] == "mxbai-embed-large"

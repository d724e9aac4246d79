import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvarn.llm import registry, shards
from kvarn.llm.base import scratch, stash

from ..parity import rows_of, sql_rows
from .conftest import SF
from .test_simhash import jaccard
from .test_tokens import check_packing  # noqa: F401


@pytest.fixture
def made(spark):
    return shards.ShardedTable(spark, scratch(spark, "test-shards"), base_bytes=1 << 10, target_bytes=64 << 10)


def test_compaction_keeps_rows_and_fills_files(made, docs):
    made.append(docs, F.pmod("doc_id", F.lit(16)))
    assert len(made.runs()) == 16
    before = made.snapshot()
    assert before.exceptAll(docs).count() == docs.exceptAll(before).count() == 0
    made.compact("doc_id")
    runs = made.runs()
    assert len(runs) < 16 and not made.plan(runs)
    assert all(r.bytes <= 2 * made.target_bytes * r.files for r in runs)
    assert made.snapshot().exceptAll(docs).count() == 0 and made.snapshot().count() == docs.count()
    assert made.versions() == list(range(1, made.versions()[-1] + 1))


def test_later_arrivals_wait_for_their_tier(made, docs):
    made.append(docs, F.pmod("doc_id", F.lit(4)))
    made.compact()
    made.append(docs.limit(1))
    made.compact()
    assert made.snapshot().count() == docs.count() + 1
    tiers = [made.tier(r) for r in made.runs()]
    assert all(tiers.count(t) < made.fanout for t in tiers)


def test_old_versions_and_conflicts(made, docs):
    made.append(docs.limit(5))
    made.append(docs.limit(3))
    assert made.snapshot(1).count() == 5 and made.snapshot().count() == 8
    with pytest.raises(shards.CommitConflict):
        made._commit(1, None, [])
    assert made.snapshot().count() == 8


def test_snapshots_outlive_compaction_until_vacuum(made, docs):
    made.append(docs, F.pmod("doc_id", F.lit(16)))
    reader = made.snapshot(1)
    made.compact("doc_id")
    assert made.versions()[-1] > 1 and reader.count() == made.snapshot(1).count() == docs.count()
    assert made.vacuum(1) > 0 and made.versions() == [made.versions()[-1]]
    assert made.snapshot().exceptAll(docs).count() == 0 and made.snapshot().count() == docs.count()


def test_repeated_rows_fill_all_files(made, spark):
    rows = spark.range(4000).select(F.lit(7).alias("k"), F.lit("same text " * 40).alias("text"), (F.col("id") % 4).alias("run"))
    made.target_bytes = 1 << 10
    made.append(rows.drop("run").withColumn("k", F.lit(7)), F.pmod(F.spark_partition_id(), F.lit(4)))
    made.compact()
    sizes = made.snapshot().groupBy(F.input_file_name()).count().collect()
    assert made.snapshot().count() == 4000 and len(sizes) > 1 and max(r["count"] for r in sizes) <= 4000 / len(sizes) + 8


def test_plan_groups_by_size(made):
    runs = [shards.Run(f"r{k}", size, 1) for k, size in enumerate([900, 1000, 70_000, 800, 1100, 70_000, 500])]
    assert [[r.name for r in g] for g in made.plan(runs)] == [["r0", "r1", "r3", "r4"]]


def test_shards_odd_rows(made, odd_docs, no_docs):
    made.append(odd_docs, F.pmod("doc_id", F.lit(2)))
    made.compact("doc_id")
    assert made.snapshot().count() == 11 and set(made.snapshot().columns) == set(odd_docs.columns)
    made.append(no_docs.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in odd_docs.dtypes]))
    assert made.snapshot().count() == 11


def test_no_shards(made, no_docs):
    with pytest.raises(ValueError):
        made.snapshot()
    made.append(no_docs)
    made.compact()
    assert made.snapshot().count() == 0


def test_native_plan(spark):
    plan = registry.QUERIES["op3_size_tiered_shards"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, name):
    frame = registry.QUERIES[name](spark, SF)
    names, expected = sql_rows(SF, registry.ORACLES[name])
    assert sorted(frame.columns) == names and rows_of(frame) == expected


def test_stages_and_names():
    assert [n.split("_")[0] for n in registry.QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    known = importlib.import_module("__spark_entry__").queries()
    assert {*registry.QUERIES, "pipeline"} <= set(known)


def test_stages_in_turn(spark, docs):
    """Each stage takes what its predecessor kept; decisions take effect and clean documents stay."""
    kept = {}
    rows, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stash(stage(spark, rows, SF), f"test-{name}")
        kept[name] = rows
        if name != "best_fit_packing":
            assert rows.columns == columns
            assert rows.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    after = {r.doc_id for r in kept["toxicity"].collect()}
    assert set(texts) - after <= toxic
    left = {r.doc_id: r.text for r in kept["simhash_near_dedup"].collect()}
    assert len(set(left.values())) == len(left)
    for gone in after - set(left):
        assert max(jaccard(texts[gone], texts[other]) for other in after if other != gone) >= 0.6
    clean = {r.doc_id for r in kept["decontamination"].collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    squash = lambda t: " ".join(t.lower().split())
    held = {i for i in left if any(squash(t) in squash(left[i]) for t in items)}
    assert held and held == set(left) - clean
    masked = {r.doc_id: r for r in kept["pii"].collect()}
    assert set(masked) == clean and all(r.n_chars == len(r.text) for r in masked.values())
    assert not any("@mail" in r.text for r in masked.values())
    assert {r.doc_id for r in kept["best_fit_packing"].collect()} == clean


def test_pipeline_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for frame, least in ((odd_docs, 5), (no_docs, 0)):
        rows = frame
        for _, stage in corpus_pipeline.STAGES:
            rows = stash(stage(spark, rows, str(tmp_path)), "test-odd")
        assert rows.count() >= least

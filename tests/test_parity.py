import pytest

from kvarn.queries import ORACLES, QUERIES

from .parity import rows_of, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    names, expected = sql_rows(FOLDER, ORACLES[name])
    assert sorted(frame.columns) == names
    assert rows_of(frame) == expected


def test_entry_point():
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(QUERIES) <= set(known)
    assert set(entry.oracle_sql()) <= set(known)


def test_collection_pruning_and_pushdown(spark):
    from kvarn.queries import read

    rows = read(spark, FOLDER, "documents").filter("source = 'src3'").select("doc_id")
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in text
    assert "text" not in text.split("ReadSchema")[1]


def test_chunk_queries_equal_plain_functions(spark):
    from kvarn.functions.metadata import python_imports
    from kvarn.operators.chunkers import choose

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = set()
    for d in docs:
        source = f"{d.source}/{d.doc_id}.md"
        pieces = choose("domain_doc", source)[1]((d.text or "").replace("\n", "\n\n"))
        want |= {(source, k, text) for k, (text, _) in enumerate(pieces)}
    assert {tuple(r) for r in QUERIES["chunked_documents"](spark, FOLDER).collect()} == want
    rows = QUERIES["ingested_chunks"](spark, FOLDER).collect()
    assert len({r.chunk_id for r in rows}) == len({(r.source, r.chunk_index) for r in rows}) == len(rows)
    assert all(len(r.embedding) == 64 for r in rows) and python_imports("import a.b") == ["a"]

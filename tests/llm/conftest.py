import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew potent ale near the old stone bridge"
    rows = [
        (1, base, "en", "s", 10), (2, base, "en", "s", 10), (3, base.upper(), None, None, None), (4, "", "en", "s", 0), (5, None, "en", "s", None),
        (6, "x " * 60_000, "en", "s", 1), (7, "a" * 50_000, "en", "s", 1), (8, "été \t\n mail a@b.co", "fr", "s", 3), (9, "   \n", None, "s", 4),
        (None, "no id at all here", "en", "s", 5), (8, "été \t\n mail a@b.co", "fr", "s", 3),
    ]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("score", "component_id", "fp", "length", "bucket", "rank", "spans"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

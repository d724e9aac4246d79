"""Registered queries over the test tables, each with the SQL that an independent engine runs for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metadata as M
from .functions import tables as T
from .functions import text as X
from .operators import cutting, history, render, search, stats
from .operators.chunkers import within_limit
from .plans import routing
from .session import scratch
from .sources import readers
from .sources import store as stores
from .streaming import ingest as streams
from .streaming import replies

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORDS = "the license the apache version erinthat"
VECTOR_ID = 7
#: Registry used on the test documents, whose vocabulary is invented.
REGISTRY = {"general": {"license": "license", "apache": "apache_license", "que": "que", "the ": "article", "Version 2": "version,two"}}
SIGNALS = {"legal": ["license", "copyright", "warranty"], "french": [" de ", " la ", " que "], "english": [" the ", " of ", " and "]}


def query(sql: str | None = None):
    def add(make: Query) -> Query:
        name = make.__name__
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


# chunks of the test tables

COLLECTION_SQL = "CASE WHEN lang = 'en' THEN 'en_code' ELSE lang || '_domain' END"
CHUNKS_SQL = f"""chunks AS (SELECT {COLLECTION_SQL} AS collection, d.doc_id AS sid, d.text, d.source AS repository, e.embedding
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""


def collection() -> Column:
    return F.when(F.col("lang") == "en", "en_code").otherwise(F.concat("lang", F.lit("_domain")))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return docs.select(collection().alias("collection"), F.col("doc_id").alias("sid"), "text", F.col("source").alias("repository"))


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select(F.col("vec_id").alias("sid"), "embedding")
    return corpus(spark, folder).join(vectors, "sid")


def vector(spark: SparkSession, folder: str) -> list[float]:
    return read(spark, folder, "embeddings").filter(F.col("vec_id") == VECTOR_ID).select("embedding").first()[0]


TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
_BM25_CTE = rf"""tok AS (SELECT collection, sid, {TOKENS_SQL} AS t FROM {{base}}),
len AS (SELECT collection, sid, len(t) AS dl FROM tok),
corp AS (SELECT collection, count(*) AS n, avg(dl) AS adl FROM len GROUP BY 1),
post AS (SELECT collection, sid, term, count(*) AS tf FROM (SELECT collection, sid, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT collection, term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN corp USING (collection)),
flo AS (SELECT collection, avg(idf) * 0.25 AS f FROM raw GROUP BY 1),
terms AS (SELECT raw.collection, term, df, CASE WHEN idf < 0 THEN f ELSE idf END AS idf FROM raw JOIN flo USING (collection)),
q AS (SELECT unnest(string_split('{WORDS}', ' ')) AS term),
hit AS (SELECT p.collection, p.sid, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / c.adl))) AS s
  FROM q JOIN post p USING (term) JOIN terms t ON t.collection = p.collection AND t.term = p.term
  JOIN len l ON l.collection = p.collection AND l.sid = p.sid JOIN corp c ON c.collection = p.collection GROUP BY ALL),
scored AS (SELECT l.collection, l.sid, round(coalesce(s, 0), 6) AS bm25 FROM len l LEFT JOIN hit USING (collection, sid)),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY bm25 DESC, sid)::INTEGER AS bm25_rank FROM scored) WHERE bm25_rank <= 40)"""
_DENSE_CTE = f"""qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = {VECTOR_ID}),
near AS (SELECT collection, sid, round(list_sum(list_transform(list_zip(embedding, v), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance FROM chunks, qv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY distance, sid)::INTEGER AS dense_rank FROM near) WHERE dense_rank <= 40)"""
_ALL_SQL = f"docs AS (SELECT {COLLECTION_SQL} AS collection, doc_id AS sid, text FROM documents)"
_HYBRID = f"""WITH {CHUNKS_SQL}, {_ALL_SQL}, {_BM25_CTE.format(base="docs")}, {_DENSE_CTE},
both_lists AS (SELECT collection, sid, dense_rank, bm25_rank,
  round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0), 9) AS rrf
  FROM dense FULL JOIN sparse USING (collection, sid))
SELECT collection, sid, dense_rank, bm25_rank, rrf FROM both_lists
ORDER BY rrf DESC, collection, coalesce(bm25_rank, 2147483647), coalesce(dense_rank, 2147483647), sid LIMIT 10"""


@query(_HYBRID)
def hybrid_search(spark, folder):
    """Words are searched in all documents, vectors in those that have one."""
    index = search.Bm25Index.build(corpus(spark, folder))
    found = search.hybrid(chunks(spark, folder), index, WORDS, vector(spark, folder), 10)
    return found.select("collection", "sid", "dense_rank", "bm25_rank", "rrf")


@query(f"WITH {CHUNKS_SQL}, {_DENSE_CTE} SELECT collection, sid, distance, dense_rank FROM dense")
def dense_search(spark, folder):
    return search.dense(chunks(spark, folder), vector(spark, folder), 40).select("collection", "sid", "distance", "dense_rank")


@query(f"WITH {CHUNKS_SQL}, {_DENSE_CTE} SELECT collection, sid, distance, dense_rank FROM dense")
def dense_cells(spark, folder):
    """The same neighbours from an index of cells."""
    index = search.VectorIndex.build(chunks(spark, folder), scratch(spark, "vectors"), cells=64)
    return index.search(vector(spark, folder), 40)


@query(f"WITH {CHUNKS_SQL}, {_DENSE_CTE} SELECT collection, sid, distance FROM dense WHERE dense_rank <= 5 ORDER BY distance, collection, sid LIMIT 5")
def dense_multi_collection(spark, folder):
    return search.dense_multi(chunks(spark, folder), vector(spark, folder), 5).select("collection", "sid", "distance")


@query(f"WITH {_ALL_SQL}, {_BM25_CTE.format(base='docs')} SELECT collection, sid, bm25, bm25_rank FROM sparse")
def bm25_search(spark, folder):
    return search.Bm25Index.build(corpus(spark, folder)).search(WORDS, 40).select("collection", "sid", "bm25", "bm25_rank")


@query(f"WITH {_ALL_SQL}, {_BM25_CTE.format(base='docs')} SELECT collection, term, df, round(idf, 6) AS idf FROM terms")
def bm25_terms(spark, folder):
    return search.Bm25Index.build(corpus(spark, folder)).terms.select("collection", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_ALL_SQL}, {_BM25_CTE.format(base='docs')} SELECT collection, sid, tf, term FROM post")
def bm25_postings(spark, folder):
    return search.Bm25Index.build(corpus(spark, folder)).postings.select("collection", "sid", "tf", "term")


@query("""WITH a AS (SELECT lang AS collection, doc_id AS sid, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents),
b AS (SELECT lang AS collection, doc_id AS sid, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
u AS (SELECT * FROM a WHERE r <= 30 UNION ALL SELECT * FROM b WHERE r <= 30)
SELECT collection, sid, round(sum(1.0 / (60 + r)), 9) AS rrf FROM u GROUP BY ALL""")
def rank_fusion(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("lang").alias("collection"), F.col("doc_id").alias("sid"), "n_chars")
    a = search.ranked(docs, [F.desc("n_chars"), F.col("sid")], 30, "r")
    return search.fuse([(a, "r"), (search.ranked(docs, [F.col("sid")], 30, "r"), "r")])


# text functions on the tables


def _nested(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        expr = f"regexp_replace({expr}, {sql_text(pattern)}, {sql_text(new)}, 'g')"
    return expr


@query(f"SELECT doc_id, {_nested('text', T.REDACTIONS)} AS clean FROM documents")
def redact_documents(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {_nested('text', [*T.REDACTIONS, ('(?i)licensed', '[customer]'), ('(?i)apache', '[customer]')])} AS clean FROM documents")
def redact_companies(spark, folder):
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", X.sanitize(F.col("text"), companies=["licensed", " Apache "]).alias("clean"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def strip_page_html(spark, folder):
    return read(spark, folder, "pages").select("page_id", X.strip_html(F.col("html")).alias("plain"))


@query(f"SELECT term, count(*)::BIGINT AS n FROM (SELECT unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def token_counts(spark, folder):
    words = read(spark, folder, "documents").select(F.explode(X.tokenize(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT doc_id, left(sha256(source || '::' || doc_id || '::' || text), 20) AS chunk_id, md5(text) AS content_hash FROM documents")
def chunk_ids(spark, folder):
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"), F.md5("text").alias("content_hash"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang || chr(31) || source || chr(31) || doc_id
 ELSE lang || chr(31) || '__h__' || chr(31) || left(sha256(left(text, 400)), 20) END AS stable_id FROM documents""")
def stable_ids(spark, folder):
    docs = read(spark, folder, "documents")
    source = F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("")
    return docs.select("doc_id", X.stable_id(F.col("lang"), source, F.col("doc_id"), F.col("text")).alias("stable_id"))


def _signal_sql(table: dict[str, list[str]]) -> str:
    scores = {n: " + ".join(f"contains(lower(text), {sql_text(s)})::INT" for s in words) for n, words in table.items()}
    parts = ", ".join(f"{{'s': ({e}), 'r': {-k}, 'n': {sql_text(n)}}}" for k, (n, e) in enumerate(scores.items()))
    return f"list_sort([{parts}], 'DESC')[1]"


@query(f"SELECT doc_id, CASE WHEN ({_signal_sql(SIGNALS)}).s > 0 THEN ({_signal_sql(SIGNALS)}).n ELSE 'general' END AS content_type FROM documents")
def content_type_custom(spark, folder):
    return read(spark, folder, "documents").select("doc_id", M.content_type(F.col("text"), SIGNALS).alias("content_type"))


SENTENCES = ["Known issue: this debug API crashes; workaround below ", "How to get rapid results, step by step ", "The algorithm computes the flow ", "",
             "That's why we chose this trade-off instead of that ", "Interface contract: depends on upstream ", "must be restricted; cannot ", "workaround "]
_SENTENCE_SQL = f"[{', '.join(map(sql_text, SENTENCES))}][(doc_id % {len(SENTENCES)} + 1)::INTEGER] || text"


@query(f"SELECT doc_id, CASE WHEN b.s > 0 THEN b.n ELSE 'general' END AS content_type FROM (SELECT doc_id, {_signal_sql(T.CONTENT_SIGNALS)} AS b FROM (SELECT doc_id, {_SENTENCE_SQL} AS text FROM documents))")
def content_type_default(spark, folder):
    """All documents, each behind a sentence that has signals."""
    lead = F.element_at(X.literals(SENTENCES), (F.pmod("doc_id", F.lit(len(SENTENCES))) + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", M.content_type(F.concat(lead, "text")).alias("content_type"))


_FOUND = ", ".join(f"CASE WHEN contains(lower(text), {sql_text(k.lower())}) THEN {sql_text(v)} END" for k, v in REGISTRY["general"].items())
CONCEPTS_SQL = f"list_sort(list_distinct(list_filter([{_FOUND}], lambda c: c IS NOT NULL)))"


@query(f"""SELECT doc_id, CASE WHEN len(c) > 0 THEN '|' || array_to_string(c, '|') || '|' ELSE '' END AS concepts
FROM (SELECT doc_id, {CONCEPTS_SQL} AS c FROM documents)""")
def concept_fields(spark, folder):
    return read(spark, folder, "documents").select("doc_id", M.chunk_concepts_field(F.col("text"), "unknown", REGISTRY).alias("concepts"))


def tagged(spark, folder) -> DataFrame:
    return corpus(spark, folder).withColumn("concepts", M.concepts(F.col("text"), "general", REGISTRY))


TAGGED_SQL = f"tagged AS (SELECT {COLLECTION_SQL} AS collection, doc_id AS sid, source, text, {CONCEPTS_SQL} AS concepts FROM documents)"


@query(f"""WITH {TAGGED_SQL} SELECT collection, sid, position FROM (SELECT collection, sid,
 row_number() OVER (PARTITION BY collection ORDER BY sid)::INTEGER AS position FROM tagged WHERE list_contains(concepts, 'version,two')) WHERE position <= 80""")
def concept_search(spark, folder):
    return search.by_concept(tagged(spark, folder), " Version,two| ").select("collection", "sid", "position")


@query(f"""WITH {TAGGED_SQL} SELECT concept, count(*)::BIGINT AS chunks FROM (SELECT unnest(concepts) AS concept FROM tagged)
GROUP BY concept ORDER BY chunks DESC, concept LIMIT 15""")
def top_concepts(spark, folder):
    return stats.top_concepts(tagged(spark, folder))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(f, CASE WHEN starts_with(f, '|') THEN '|' ELSE ',' END), lambda p: trim(p)), lambda p: p <> ''), ';') AS parts
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '|' || source || '|' || lang || ',x|' WHEN 1 THEN lang || ' ,, ' || source || ',' || doc_id WHEN 2 THEN '' ELSE source END AS f FROM documents)""")
def concept_parts(spark, folder):
    which = F.pmod("doc_id", F.lit(4))
    field = F.when(which == 0, _format("|{source}|{lang},x|")).when(which == 1, _format("{lang} ,, {source},{doc_id}")).when(which == 2, "").otherwise(F.col("source"))
    return read(spark, folder, "documents").select("doc_id", F.array_join(X.concept_parts(field), ";").alias("parts"))


def coded(spark: SparkSession, folder: str, cases: list[tuple[str, Column]]) -> DataFrame:
    """Documents as source files: the k-th case (extension, text) for ids that leave k."""
    docs, which = read(spark, folder, "documents"), F.pmod("doc_id", F.lit(len(cases)))
    ext, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (extension, body) in enumerate(cases):
        ext, text = F.when(which == k, extension).otherwise(ext), F.when(which == k, body).otherwise(text)
    return docs.select("doc_id", ext.alias("ext"), text.alias("code"))


def _format(pattern: str) -> Column:
    """A pattern with {lang}, {source} and {doc_id} filled in from the row."""
    parts = re.split(r"(\{(?:lang|source|doc_id)\})", pattern)
    return F.concat(*[F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts if p])


IMPORTING = [
    (".js", "import x from 'lib/{source}.js'; const b = require(\"{lang}\")", "[source, lang]"),
    (".ts", "import('deep/er/{source}')", "[source]"),
    (".c", "#include <{source}.h>\n# include \"{lang}.h\"", "[source || '.h', lang || '.h']"),
    (".java", "import java.{lang}.{source};\nimport a.B;", "['java.' || lang || '.' || source, 'a.B']"),
    (".rs", "pub use std::{source};\nuse crate::x;\nmod {lang};", "['std', lang]"),
    (".go", "import \"{source}/{lang}\"", "[source || '/' || lang]"),
    (".txt", "import {source}", "[]"),
]


def _names_sql(cases: list[tuple[str, str, str]]) -> str:
    picks = " ".join(f"WHEN {k} THEN {names}::VARCHAR[]" for k, (_, _, names) in enumerate(cases))
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct(CASE doc_id % {len(cases)} {picks} END)), ', ') AS deps FROM documents"


@query(_names_sql(IMPORTING))
def import_names(spark, folder):
    rows = coded(spark, folder, [(ext, _format(text)) for ext, text, _ in IMPORTING])
    return rows.select("doc_id", M.dependencies(F.col("code"), F.col("ext"), with_python=False).alias("deps"))


PYTHON = [
    (".py", "import os.{lang}, {source}\nfrom a.b import c{doc_id}, d as e\n", "['os', source, 'a', 'c' || doc_id, 'd']"),
    (".py", "from . import {lang}\nfrom {source} import *\n", "[lang, source]"),
    (".py", "def broken(:\nimport {source}.x\n", "[source]"),
    (".py", "{source} = 1", "[]"),
]


@query(_names_sql(PYTHON))
def python_import_names(spark, folder):
    rows = coded(spark, folder, [(ext, _format(text)) for ext, text, _ in PYTHON])
    return rows.select("doc_id", M.dependencies(F.col("code"), F.col("ext")).alias("deps"))


@query("SELECT url, split_part(p, '/', 1) AS repository, CASE WHEN contains(p, '/') THEN regexp_replace(p, '^[^/]*/', '') ELSE p END AS relative_path FROM (SELECT url, regexp_replace(url, '^https?://', '') AS p FROM pages)")
def repository_paths(spark, folder):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, folder, "pages").select("url", M.repository(path).alias("repository"), M.relative_path(path).alias("relative_path"))


@query("""SELECT o_orderkey AS id FROM orders WHERE (o_custkey % 5 = 0 OR o_custkey % 5 IN (1, 2, 3)) AND o_orderstatus = 'F' AND contains(o_orderpriority, 'HIGH')""")
def ticket_filter(spark, folder):
    """Orders as tickets: a severity that may be blank, a state and a priority."""
    rules = M.parse_ticket_filter("severity=1,2,3 state=f priority=High")
    severity = F.pmod("o_custkey", F.lit(5)).cast("string")
    keep = M.matches_ticket_filter(rules, F.when(severity != "0", severity), F.col("o_orderstatus"), F.col("o_orderpriority"))
    return read(spark, folder, "orders").filter(keep).select(F.col("o_orderkey").alias("id"))


_LADDER = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN upper(lang) || ' ' ELSE '' END AS given, CASE doc_id % 5 WHEN 0 THEN 'my_rfc' WHEN 1 THEN 'Community' WHEN 2 THEN 'customer_ticket' WHEN 3 THEN 'wiki' END AS strategy, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS rally, CASE WHEN doc_id % 2 = 0 THEN lang END AS ticket FROM documents"


@query(f"""SELECT doc_id, CASE WHEN trim(given) <> '' THEN lower(trim(given)) WHEN contains(lower(coalesce(strategy, '')), 'rfc') THEN 'rfc'
 WHEN coalesce(rally, '') <> '' THEN 'rally' WHEN coalesce(ticket, '') <> '' THEN 'customer' WHEN contains(lower(coalesce(strategy, '')), 'wiki') THEN 'wiki'
 WHEN contains(lower(coalesce(strategy, '')), 'community') THEN 'community' ELSE 'code' END AS kind FROM ({_LADDER})""")
def source_types(spark, folder):
    which = lambda n: F.pmod("doc_id", F.lit(n))
    names = F.element_at(F.array(F.lit("my_rfc"), F.lit("Community"), F.lit("customer_ticket"), F.lit("wiki"), F.lit(None)), which(5).cast("int") + 1)
    given, rally = F.when(which(7) == 0, F.concat(F.upper("lang"), F.lit(" "))).otherwise(""), F.when(which(3) == 0, F.col("source")).otherwise("")
    kind = M.infer_source_type(given, names, rally, F.when(which(2) == 0, F.col("lang")))
    return read(spark, folder, "documents").select("doc_id", kind.alias("kind"))


@query("SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4046) || chr(10) || chr(10) || '... (truncated for response size) ...' ELSE text END AS shown FROM documents")
def truncated_chunks(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.truncate(F.col("text")).alias("shown"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::INTEGER AS tokens FROM documents")
def token_estimates(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


_TAGS_SQL = " ".join(f"WHEN {sql_text(e)} THEN {sql_text(t)}" for e, t in T.LANGUAGE_TAGS.items())
_EXTENSIONS = [*T.LANGUAGE_TAGS, ".none", ""]
_EXT_SQL = f"{_EXTENSIONS}[(doc_id % {len(_EXTENSIONS)} + 1)::INTEGER]"
_FENCED_SQL = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '```') ELSE text END AS t FROM documents"


@query(f"SELECT doc_id, CASE WHEN contains(t, '```') THEN '~~~' ELSE '```' END AS fence, CASE {_EXT_SQL} {_TAGS_SQL} ELSE '' END AS tag FROM ({_FENCED_SQL})")
def fences(spark, folder):
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.replace("text", F.lit(" "), F.lit("```"))).otherwise(F.col("text"))
    ext = F.element_at(X.literals(_EXTENSIONS), (F.pmod("doc_id", F.lit(len(_EXTENSIONS))) + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", X.fence(text).alias("fence"), X.language_tag(F.upper(ext)).alias("tag"))


_ASKED = {0: "@Web {} @docs now", 1: "{}", 2: "@codebase @codebase {}", 3: "x@web {} @Docs"}
_ASKED_SQL = " ".join(f"WHEN {k} THEN replace({sql_text(t)}, '{{}}', text)" for k, t in _ASKED.items())


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(t), '@(web|codebase|docs)\\b', 1))), ',') AS found,
 regexp_replace(regexp_replace(t, '(?i)@(web|codebase|docs)\\b', '', 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned
 FROM (SELECT doc_id, CASE doc_id % 4 {_ASKED_SQL} END AS t FROM documents)""")
def at_mentions(spark, folder):
    text = F.lit(None).cast("string")
    for k, pattern in _ASKED.items():
        before, _, after = pattern.partition("{}")
        text = F.when(F.pmod("doc_id", F.lit(4)) == k, F.concat(F.lit(before), "text", F.lit(after))).otherwise(text)
    rows = read(spark, folder, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.array_join(X.mentions(F.col("t")), ",").alias("found"), X.without_mentions(F.col("t")).alias("cleaned"))


@query("""SELECT doc_id, CASE WHEN bare = '' OR length(bare) > 500 THEN source ELSE bare END AS answer
 FROM (SELECT doc_id, source, regexp_replace(trim(string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1]), '^["''`]+|["''`]+$', '', 'g') AS bare FROM documents)""")
def rewritten_queries(spark, folder):
    """Every text as a model's answer behind lead-ins and quotes."""
    lead = F.element_at(X.literals(["Rewritten query: ", "  Query: '", "here is the query: \"", ""]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    got = F.concat(lead, F.regexp_replace("text", r"^\s+", ""))
    return read(spark, folder, "documents").select("doc_id", X.sanitize_rewrite(got, F.col("source")).alias("answer"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '{"name":"' || source || '"}' END AS call, CASE WHEN doc_id % 3 = 2 THEN trim(text, ' ') END AS done FROM documents""")
def tool_calls(spark, folder):
    which, call = F.pmod("doc_id", F.lit(3)), F.concat(F.lit('{"name":"'), "source", F.lit('"}'))
    text = F.when(which == 0, F.concat("text", F.lit(" <tool_call>"), call, F.lit("</tool_call> b"))).when(
        which == 1, F.concat(F.lit("<tool_call>```json\n"), call, F.lit("\n```</tool_call>"), "text")
    ).otherwise(F.concat(F.lit("<task_complete> "), "text", F.lit(" </task_complete>")))
    rows = read(spark, folder, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", X.tool_call(F.col("t")).alias("call"), X.task_complete(F.col("t")).alias("done"))


_PATHS_SQL = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '../' || url WHEN 2 THEN ' /' || replace(url, '/', '\\') || chr(10)
  WHEN 3 THEN url || '/..' WHEN 4 THEN './..' || url || '/./x..' ELSE replace(url, '.', '/../') END AS p FROM pages"""


@query(f"""SELECT page_id, CASE WHEN list_contains(parts, '..') THEN NULL ELSE array_to_string(list_concat(['/work'], list_filter(parts, lambda x: x NOT IN ('', '.'))), '/') END AS path
FROM (SELECT page_id, string_split(replace(regexp_replace(p, '^\\s+|\\s+$', '', 'g'), '\\', '/'), '/') AS parts FROM ({_PATHS_SQL}))""")
def safe_paths(spark, folder):
    """The addresses of all pages as paths below a folder, some of which would leave it."""
    url = F.col("url")
    kind = F.pmod("page_id", F.lit(6))
    path = (
        F.when(kind == 0, url).when(kind == 1, F.concat(F.lit("../"), url))
        .when(kind == 2, F.concat(F.lit(" /"), F.replace(url, F.lit("/"), F.lit("\\")), F.lit("\n")))
        .when(kind == 3, F.concat(url, F.lit("/.."))).when(kind == 4, F.concat(F.lit("./.."), url, F.lit("/./x..")))
        .otherwise(F.replace(url, F.lit("."), F.lit("/../")))
    )
    return read(spark, folder, "pages").select("page_id", X.safe_path(path, "/work/").alias("path"))


_REPLY_SQL = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN text || ' <tool_call>{"name":"' || role || '"}</tool_call>' || text
  WHEN 2 THEN '```' || chr(10) || text || '<tool_call>' || chr(10) || '  ```x' || chr(10) || text || chr(10) || '<task_complete>' || role
  WHEN 3 THEN text || '<task_comp' ELSE '```' || chr(10) || text || chr(10) || '```<tool_call' END AS t FROM conversations"""


@query(f"""WITH replies AS ({_REPLY_SQL}), lines AS (
  SELECT conv_id, turn, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM replies
), placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER earlier, 0) AS begins, coalesce(sum(CASE WHEN regexp_matches(line, '^[ \\t\\r]*```') THEN 1 ELSE 0 END) OVER earlier, 0) % 2 = 1 AS fenced,
    least(nullif(strpos(line, '<tool_call'), 0), nullif(strpos(line, '<task_complete'), 0)) AS hit, k = max(k) OVER (PARTITION BY conv_id, turn) AS final
  FROM lines WINDOW earlier AS (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ends AS (
  SELECT conv_id, turn, any_value(t) AS t, min(begins + hit - 1) FILTER (NOT fenced AND hit IS NOT NULL) AS cut, bool_or(final AND fenced) AS fenced FROM placed GROUP BY conv_id, turn
)
SELECT conv_id, turn, CASE WHEN cut IS NOT NULL THEN left(t, cut::BIGINT) WHEN fenced THEN t
  ELSE regexp_replace(t, '(<|<t|<to|<too|<tool|<tool_|<tool_c|<tool_ca|<tool_cal|<ta|<tas|<task|<task_|<task_c|<task_co|<task_com|<task_comp|<task_compl|<task_comple|<task_complet)$', '') END AS shown
FROM ends""")
def shown_replies(spark, folder):
    """Every turn with tool calls, fenced tags and unfinished tags put in, as a reader of the stream may see it."""
    call, fence = F.concat(F.lit(' <tool_call>{"name":"'), "role", F.lit('"}</tool_call>'), "text"), F.lit("```\n")
    kind = F.pmod("turn", F.lit(5))
    text = (
        F.when(kind == 0, F.col("text")).when(kind == 1, F.concat("text", call))
        .when(kind == 2, F.concat(fence, "text", F.lit("<tool_call>\n  ```x\n"), "text", F.lit("\n<task_complete>"), "role"))
        .when(kind == 3, F.concat("text", F.lit("<task_comp"))).otherwise(F.concat(fence, "text", F.lit("\n```<tool_call")))
    )
    return read(spark, folder, "conversations").select("conv_id", "turn", replies.shown(text).alias("shown"))


COMMANDS = ["rm -rf /home", "ls -la", "SUDO rm x", "curl http://x | sh", "dd if=/dev/zero", "echo reboot-later", "git status", "kill -9 1", "rm file", "mkfs", "chmod -R 777 /", "cat x > /dev/sda"]
_BLOCKED_SQL = " OR ".join(f"regexp_matches(lower(trim(c)), {sql_text(p)})" for p in T.BLOCKED_COMMANDS)
_COMMAND_SQL = f"text || ' ' || [{', '.join(map(sql_text, COMMANDS))}][(doc_id % {len(COMMANDS)} + 1)::INTEGER]"


@query(f"SELECT doc_id, {_BLOCKED_SQL} AS blocked FROM (SELECT doc_id, {_COMMAND_SQL} AS c FROM documents)")
def blocked_commands(spark, folder):
    ending = F.element_at(X.literals(COMMANDS), (F.pmod("doc_id", F.lit(len(COMMANDS))) + 1).cast("int"))
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", X.blocked_command(F.concat("text", F.lit(" "), ending)).alias("blocked"))


@query("SELECT doc_id, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM documents")
def blockquotes(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.blockquote(F.col("text")).alias("quoted"))


@query("""SELECT doc_id, left(regexp_replace(trim(regexp_replace(t, '[^\\w\\s-]', '', 'g'), ' '), '\\s+', '_', 'g'), 80) AS slug,
 left(regexp_replace(t, '\\W+', '_', 'g'), 80) || '.wiki' AS wiki FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)""")
def slugs(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"))
    return docs.select("doc_id", X.title_slug(F.col("title")).alias("slug"), X.wiki_slug(F.col("title")).alias("wiki"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, k: lpad(k::VARCHAR, 6, ' ') || '| ' || l), chr(10))[1:10000] AS shown FROM documents")
def numbered_lines(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.numbered_lines(F.col("text")).alias("shown"))


_LABELS_SQL = " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in T.DIAGRAM_LABELS.items())
_WORDS = [*T.DIAGRAM_LABELS, "text"]
_WORD_SQL = f"[{', '.join(map(sql_text, _WORDS))}][(doc_id % {len(_WORDS)} + 1)::INTEGER]"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE {_WORD_SQL} {_LABELS_SQL} ELSE '' END
 ELSE CASE rtrim(regexp_extract(lower(trim(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))[1], ' ')), '^[^\\s(\\[\\x7b]*'), ':;') {_LABELS_SQL} ELSE '' END END AS label FROM documents""")
def diagram_labels(spark, folder):
    """Even ids open a mermaid fence with every known first word in turn, odd ones are plain texts."""
    word = F.element_at(X.literals(_WORDS), (F.pmod("doc_id", F.lit(len(_WORDS))) + 1).cast("int"))
    block = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("```mermaid\n"), word, F.lit(" {\n"), "text")).otherwise(F.col("text"))
    return read(spark, folder, "documents").select("doc_id", X.diagram_label(block).alias("label"))


_LINE_SQL = "CASE (doc_id + k) % 4 WHEN 0 THEN translate(x, 'aeion', '+-|  ') WHEN 1 THEN regexp_replace(x, '[a-zA-Z,.]', doc_id::VARCHAR, 'g') WHEN 2 THEN '| ' || x || ' +-' ELSE x END"


@query(rf"""SELECT doc_id, line, trim(l, ' ') <> '' AND (regexp_matches(l, '[+|]\s*[-+]{{2,}}') OR regexp_matches(l, '[-+]{{2,}}\s*[+|]')
 OR (contains(l, '|') AND (regexp_matches(l, '\+-') OR regexp_matches(l, '-\+') OR regexp_matches(l, '\.-')))
 OR (regexp_matches(trim(l, ' '), '^[\d\s]{{10,}}$') AND length(regexp_replace(l, '\D', '', 'g')) >= 4)) AS drawn
 FROM (SELECT doc_id, k::INTEGER AS line, {_LINE_SQL} AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents))""")
def drawing_lines(spark, folder):
    """Every line of all documents, in turn made into drawings, digits and half-drawn lines."""
    lines = read(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    which = F.pmod(F.col("doc_id") + F.col("line"), F.lit(4))
    drawn = F.when(which == 0, F.translate("x", "aeion", "+-|  ")).when(which == 1, F.regexp_replace("x", F.lit("[a-zA-Z,.]"), F.col("doc_id").cast("string")))
    drawn = drawn.when(which == 2, F.concat(F.lit("| "), "x", F.lit(" +-"))).otherwise(F.col("x"))
    return lines.select("doc_id", "line", X.rfc_line_is_diagram(drawn).alias("drawn"))


@query("SELECT url, regexp_matches(url, '(?i)(^|/)[^/]*rfc[0-9]+[^/]*[.]txt$') AS is_rfc, lower(regexp_extract(url, '([.][^./]+)$', 1)) AS ext FROM pages")
def path_kinds(spark, folder):
    return read(spark, folder, "pages").select("url", X.is_rfc_file(F.col("url")).alias("is_rfc"), readers.extension(F.col("url")).alias("ext"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id + 1, doc_id % 7 + 9000, doc_id % 7 + 9001, doc_id % 7 + 9002, doc_id + 3])), ',') AS rfcs FROM documents""")
def rfc_list(spark, folder):
    """A list with single numbers, a range and a repeat for every document."""
    low = F.pmod("doc_id", F.lit(7)) + 9000
    text = F.concat_ws(" ", F.concat(F.col("doc_id") + 1, F.lit(","), F.col("doc_id") + 1), F.concat(low, F.lit("-"), low + 2), (F.col("doc_id") + 3).cast("string"))
    return read(spark, folder, "documents").select("doc_id", F.array_join(X.rfc_numbers(text), ",").alias("rfcs"))


# metadata, routing


@query("SELECT doc_id::VARCHAR AS source, lang AS domain, source AS repository, n_chars::VARCHAR AS chunk_index, '' AS subsection, '' AS dependencies FROM documents")
def metadata_rows(spark, folder):
    docs = read(spark, folder, "documents")
    rows = docs.select(F.col("doc_id").alias("source"), F.col("lang").alias("domain"), F.col("source").alias("repository"), F.col("n_chars").alias("chunk_index"), "text")
    return M.finalize(rows).select("source", "domain", "repository", "chunk_index", "subsection", "dependencies")


MODES = [*T.COLLECTION_BY_MODE, "other"]
_MODE_SQL = f"{MODES}[(doc_id % {len(MODES)} + 1)::INTEGER]"


def moded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a mode each in turn, their language as domain."""
    mode = F.element_at(X.literals(MODES), (F.pmod("doc_id", F.lit(len(MODES))) + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", mode.alias("mode"), F.col("lang").alias("domain"))


_ROUTED_SQL = f"""(SELECT doc_id, mode, CASE mode WHEN 'code' THEN lang || '_code' WHEN 'domain' THEN lang || '_domain' WHEN 'rfc' THEN 'rfc' WHEN 'rally' THEN lang || '_internal'
 WHEN 'customer' THEN lang || '_customer' WHEN 'mib' THEN lang || '_mib' WHEN 'wiki' THEN lang || '_wiki' WHEN 'release-notes' THEN lang || '_releases'
 WHEN 'theory' THEN 'theory' WHEN 'community' THEN 'community' ELSE lang || '_misc' END AS collection FROM (SELECT *, {_MODE_SQL} AS mode FROM documents))"""


@query(f"""SELECT doc_id, collection, CASE mode WHEN 'domain' THEN 'domain_doc' WHEN 'release-notes' THEN 'release_notes' WHEN 'other' THEN 'domain_doc' ELSE mode END AS source_type
 FROM {_ROUTED_SQL}""")
def collection_routes(spark, folder):
    rows = moded(spark, folder)
    return rows.select("doc_id", routing.collection_of(F.col("mode"), F.col("domain")).alias("collection"), routing.source_type_of(F.col("mode")).alias("source_type"))


_KINDS = ["auto", "code", "domain", "troubleshoot", "reference", "odd"]


@query(f"""SELECT kind, collection, count(*)::BIGINT AS n FROM {_ROUTED_SQL} n JOIN (SELECT unnest({_KINDS}) AS kind) k ON CASE kind
 WHEN 'code' THEN collection LIKE '%\\_code' ESCAPE '\\' WHEN 'domain' THEN contains(collection, '_domain') OR collection = 'theory'
 WHEN 'troubleshoot' THEN contains(collection, '_domain') OR contains(collection, 'community') OR contains(collection, '_customer') OR contains(collection, '_internal')
 WHEN 'reference' THEN collection IN ('rfc', 'theory') OR contains(collection, '_mib') OR ends_with(collection, '_releases') ELSE true END GROUP BY ALL""")
def search_routes(spark, folder):
    """Documents that each search type reaches, by collection."""
    rows = moded(spark, folder).select(routing.collection_of(F.col("mode"), F.col("domain")).alias("collection"))
    takes = F.array(*[F.when(routing.for_search(F.col("collection"), k), k) for k in _KINDS])
    return rows.select("collection", F.explode(F.array_compact(takes)).alias("kind")).groupBy("kind", "collection").agg(F.count("*").alias("n"))


@query(f"SELECT collection, count(*)::BIGINT AS n FROM (SELECT {COLLECTION_SQL} AS collection FROM documents) WHERE contains(collection, 'fr') GROUP BY 1")
def domain_filter(spark, folder):
    rows = corpus(spark, folder).filter(routing.in_domain(F.col("collection"), " FR "))
    return rows.groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE (source = 'src1' OR source = 'src2') AND lang <> 'en' AND contains(text, 'que')")
def where_language(spark, folder):
    clause = {"$and": [{"$or": [{"source": "src1"}, {"source": {"$eq": "src2"}}]}, {"lang": {"$ne": "en"}}, {"text": {"$contains": "que"}}]}
    return read(spark, folder, "documents").filter(routing.where(clause)).select("doc_id")


@query(f"""WITH {_ALL_SQL}, {_BM25_CTE.format(base='docs')} SELECT collection, sid, bm25, bm25_rank FROM (SELECT s.collection, s.sid, bm25,
 row_number() OVER (PARTITION BY s.collection ORDER BY bm25 DESC, s.sid)::INTEGER AS bm25_rank FROM scored s JOIN documents d ON d.doc_id = s.sid WHERE d.source = 'src3') WHERE bm25_rank <= 40""")
def repository_post_filter(spark, folder):
    """The repository limits what is ranked; term weights stay those of the whole corpus."""
    rows = corpus(spark, folder)
    found = search.Bm25Index.build(rows).search(WORDS, 40, rows.filter(F.col("repository") == "src3"))
    return found.select("collection", "sid", "bm25", "bm25_rank")


# dependents

_GRAPH_SQL = f"""g AS (SELECT {COLLECTION_SQL} AS collection, doc_id AS sid, source || '/m' || doc_id % 40 || '.py' AS relative_path, 'f' || doc_id % 30 AS chunk_name,
 'm' || (doc_id * 7) % 40 || ', ' || lang || ', f' || (doc_id * 3) % 90 AS dependencies, source FROM documents)"""


def graph(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files that define a name and depend on others."""
    part = lambda mark, times, n: F.concat(F.lit(mark), F.pmod(F.col("sid") * times, F.lit(n)))
    rows = corpus(spark, folder).withColumn("relative_path", F.concat("repository", F.lit("/"), part("m", 1, 40), F.lit(".py")))
    lang = read(spark, folder, "documents").select(F.col("doc_id").alias("sid"), "lang")
    needs = F.concat_ws(", ", part("m", 7, 40), "lang", part("f", 3, 90))
    return rows.join(lang, "sid").withColumn("chunk_name", part("f", 1, 30)).withColumn("dependencies", needs)


@query(f"""WITH {_GRAPH_SQL}, s AS (SELECT 'm' || sid % 40 AS stem FROM g WHERE source = 'src1' UNION SELECT chunk_name FROM g WHERE source = 'src1')
SELECT collection, sid FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY sid) AS r FROM g WHERE list_has_any(string_split(dependencies, ', '), (SELECT list(stem) FROM s)))
WHERE r <= 10 ORDER BY collection, sid LIMIT 10""")
def dependents(spark, folder):
    rows = graph(spark, folder)
    return search.dependents(rows, search.stems(rows.filter("repository = 'src1'")), 10).select("collection", "sid")


@query(f"WITH {_GRAPH_SQL} SELECT DISTINCT unnest(['m' || sid % 40, chunk_name]) AS stem FROM g WHERE source IN ('src1', 'src2')")
def dependent_stems(spark, folder):
    return search.stems(graph(spark, folder).filter("repository IN ('src1', 'src2')"))


# keywords


@query(r"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS word FROM benchmark)
SELECT doc_id, string_agg(word, ' ' ORDER BY word) AS concepts FROM documents JOIN w ON contains(lower(text), word) GROUP BY doc_id""")
def keyword_concepts(spark, folder):
    """Every word of the benchmark items is a keyword, looked for in all documents at once."""
    words = read(spark, folder, "benchmark").select(F.explode(X.tokenize(F.col("text"))).alias("keyword"))
    registry = words.select(F.lit("general").alias("domain"), "keyword", F.col("keyword").alias("concept"))
    docs = read(spark, folder, "documents").select("doc_id", "text", F.lit("general").alias("domain"))
    found = M.concepts_by_join(docs, registry, "doc_id").filter("concepts IS NOT NULL")
    return found.select("doc_id", F.array_join("concepts", " ").alias("concepts"))


# aggregates


@query(f"""SELECT collection, count(*)::BIGINT AS chunks, count(DISTINCT source)::BIGINT AS sources, max(n_chars) AS latest
 FROM (SELECT {COLLECTION_SQL} AS collection, * FROM documents) GROUP BY 1""")
def status(spark, folder):
    docs = read(spark, folder, "documents").withColumn("collection", collection()).withColumn("ingested", F.col("n_chars"))
    return stats.status(docs)


@query("SELECT content_type, count(*)::BIGINT AS chunks FROM (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'general' END AS content_type FROM labels) GROUP BY 1")
def content_types(spark, folder):
    labels = read(spark, folder, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("general").alias("content_type"))
    return stats.content_types(labels)


@query("""SELECT repository, count(DISTINCT source)::BIGINT AS files, count_if(kind = 'rfc')::BIGINT AS rfc, count_if(kind IN ('rally', 'customer'))::BIGINT AS tickets,
 count_if(kind = 'mib')::BIGINT AS mib FROM (SELECT source AS repository, text AS source, CASE lang WHEN 'en' THEN 'rfc' WHEN 'de' THEN 'rally' WHEN 'fr' THEN 'customer' ELSE 'mib' END AS kind FROM documents) GROUP BY 1""")
def repositories(spark, folder):
    kind = F.when(F.col("lang") == "en", "rfc").when(F.col("lang") == "de", "rally").when(F.col("lang") == "fr", "customer").otherwise("mib")
    docs = read(spark, folder, "documents").select(F.col("source").alias("repository"), F.col("text").alias("source"), kind.alias("source_type"))
    return stats.repositories(docs)


@query(f"""WITH {TAGGED_SQL}, c AS (SELECT source, list_sort(list_distinct(flatten(list(concepts)))) AS concepts FROM tagged GROUP BY 1)
SELECT source, count(*)::BIGINT AS chunks, count(DISTINCT collection)::BIGINT AS sections, array_to_string(any_value(c.concepts), ',') AS concepts
FROM tagged JOIN c USING (source) GROUP BY source""")
def feed_statistics(spark, folder):
    rows = tagged(spark, folder).withColumn("source", F.col("repository")).withColumn("section", F.col("collection"))
    return stats.feed_stats(rows).withColumn("concepts", F.array_join("concepts", ","))


# windows


@query("""WITH b AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p, doc_id, source, text, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT *, '[Source ' || p || ': ' || source || ' (' || lang || ')]' || chr(10) || text AS block FROM b),
t AS (SELECT *, sum(length(block)) OVER (PARTITION BY lang ORDER BY p) AS total FROM s)
SELECT lang, p::INTEGER AS position, CASE WHEN total > 32000 THEN chr(10) || '[... ' || (n - p + 1) || ' more chunks omitted due to context limit]' ELSE block END AS block,
 total::BIGINT AS total FROM t WHERE total - length(block) <= 32000""")
def context_packing(spark, folder):
    docs = read(spark, folder, "documents").withColumn("source_type", F.col("lang"))
    return history.pack_context(docs, ["doc_id"], 32_000, ["lang"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def last_turns(spark, folder):
    return history.last_turns(read(spark, folder, "conversations"), 3).select("conv_id", "turn", "role")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
c AS (SELECT conv_id, turn, role, left(text, 8000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b2 FROM a WHERE b <= 24 AND role IN ('user', 'assistant'))
SELECT conv_id, turn, role, text FROM c WHERE b2 <= 20""")
def clean_history(spark, folder):
    return history.sanitize_history(read(spark, folder, "conversations")).select("conv_id", "turn", "role", "text")


@query("""WITH r AS (SELECT conv_id, turn, text, CASE WHEN turn % 4 < 2 THEN 'user' ELSE 'assistant' END AS role, turn % 7 <> 3 AS plain FROM conversations),
f AS (SELECT *, CASE WHEN lag(role) OVER w = role AND plain AND lag(plain) OVER w THEN 0 ELSE 1 END AS starts FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
SELECT conv_id, min(turn) AS turn, any_value(role) AS role, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, run""")
def merged_roles(spark, folder):
    role = F.when(F.pmod("turn", F.lit(4)) < 2, "user").otherwise("assistant")
    rows = read(spark, folder, "conversations").withColumn("role", role)
    return history.merge_roles(rows, is_plain=F.pmod("turn", F.lit(7)) != 3).select("conv_id", "turn", "role", "text")


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '[Tool Result: x] ' || text ELSE text END AS text, CASE WHEN role = 'assistant' THEN 'user' ELSE role END AS role, role = 'assistant' AS tool FROM conversations),
w AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) AS total, sum(tool::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t)
SELECT conv_id, turn, role, CASE WHEN total / 3.5 >= 80 AND tool AND back > 3 AND length(text) > 200
 THEN left(text, 120) || chr(10) || '... [Truncated tool result, was ' || length(text) || ' chars]' ELSE text END AS text FROM w""")
def truncated_tool_results(spark, folder):
    rows = read(spark, folder, "conversations")
    is_tool = F.col("role") == "assistant"
    rows = rows.select("conv_id", "turn", F.when(is_tool, "user").otherwise(F.col("role")).alias("role"), F.when(is_tool, F.concat(F.lit("[Tool Result: x] "), "text")).otherwise(F.col("text")).alias("text"))
    return history.truncate_tool_results(rows, 100)


@query("""SELECT conv_id, string_agg('Q: ' || text || chr(10) || 'A: ' || left(role, 500), chr(10) ORDER BY turn) AS context
 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 2 GROUP BY 1""")
def recent_context(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.lit("").alias("reformulated"), F.col("role").alias("answer_summary"))
    return history.recent_text(turns)


# sources and state


@query("SELECT d.doc_id AS source, md5(d.text) AS md5 FROM documents d LEFT JOIN labels l USING (doc_id) WHERE md5(d.text) IS DISTINCT FROM CASE WHEN l.doc_id % 2 = 0 THEN md5(d.text) WHEN l.doc_id % 2 = 1 THEN 'old' END")
def unseen_sources(spark, folder):
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("source"), F.md5("text").alias("md5"))
    marks = read(spark, folder, "labels").select(F.col("doc_id").alias("source"), (F.col("doc_id") % 2).alias("odd")).join(docs, "source")
    seen = marks.select("source", F.when(F.col("odd") == 0, F.col("md5")).otherwise("old").alias("md5"))
    return stores.unseen(docs, seen).select("source", "md5")


@query("""SELECT d.lang || '/' || doc_id AS source FROM labels l JOIN documents d USING (doc_id) WHERE d.lang IN ('fr', 'de') AND d.source <> 'src1'
 AND (d.lang = 'fr' OR d.source = 'src2') GROUP BY ALL""")
def vanished_sources(spark, folder):
    """Two folders are looked through, each for its own: all of fr/ but src1 has gone, of de/src2 too, and en/ was not looked at."""
    docs = read(spark, folder, "documents").select("doc_id", "lang", "source")
    named = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    seen = read(spark, folder, "labels").select("doc_id").distinct().join(docs, "doc_id").select(named.alias("source"))
    there = docs.filter("source = 'src1' OR (lang = 'de' AND source <> 'src2')").select(named.alias("source"))
    return stores.vanished(seen, there, "fr").unionByName(stores.vanished(seen, there, "de/"))


@query("""WITH r AS (SELECT doc_id, doc_id % 3 AS seq, lang, row_number() OVER () AS n FROM documents UNION ALL SELECT doc_id, 3 AS seq, lang, 0 AS n FROM documents WHERE source = 'src1'),
k AS (SELECT doc_id, 1 AS seq, lang FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 3 AS seq, lang FROM documents WHERE source = 'src1' OR source = 'src2')
SELECT doc_id AS sid, seq, lang AS collection FROM r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND k.lang = r.lang AND k.seq > r.seq)""")
def merged_runs(spark, folder):
    """Merge on read: rows of four runs less those that later runs replace or remove."""
    docs = read(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("collection"), "source")
    again = docs.filter("source = 'src1'").withColumn("seq", F.lit(3).cast("long"))
    rows = docs.withColumn("seq", F.pmod("chunk_id", F.lit(3))).unionByName(again)
    kills = docs.filter("collection = 'fr'").withColumn("seq", F.lit(1)).unionByName(docs.filter("source IN ('src1', 'src2')").withColumn("seq", F.lit(3)))
    return stores.live(rows, kills).select(F.col("chunk_id").alias("sid"), "seq", "collection")


@query("""WITH s AS (SELECT lang AS collection, source, md5(text) AS md5, doc_id AS seq FROM documents)
SELECT collection, source, CASE WHEN max(seq) % 2 = 0 THEN NULL ELSE arg_max(md5, seq) END AS md5, max(seq) AS seq FROM s GROUP BY ALL""")
def latest_sources(spark, folder):
    """The checkpoint as the last run's word on each source; a null hash takes a source out."""
    docs = read(spark, folder, "documents").select(F.col("lang").alias("collection"), "source", F.col("doc_id").alias("seq"), F.md5("text").alias("md5"))
    return stores.latest(docs.withColumn("md5", F.when(F.col("seq") % 2 != 0, F.col("md5"))))


@query("""WITH old AS (SELECT doc_id, doc_id % 50 AS source FROM labels GROUP BY doc_id), fresh AS (SELECT doc_id, doc_id % 50 AS source FROM documents WHERE lang = 'en'),
gone AS (SELECT DISTINCT source FROM fresh)
SELECT o.doc_id AS sid, CASE WHEN f.doc_id IS NOT NULL THEN 'replaced' WHEN g.source IS NOT NULL THEN 'stale' ELSE 'kept' END AS fate
FROM old o LEFT JOIN fresh f ON o.doc_id = f.doc_id LEFT JOIN gone g ON o.source = g.source""")
def upsert_counts(spark, folder):
    """What an upsert does to each stored chunk."""
    source = F.pmod("doc_id", F.lit(50)).alias("source")
    old = read(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), source).distinct()
    fresh = read(spark, folder, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), source)
    return stores.fates(old, fresh, fresh.select("source").distinct()).select(F.col("chunk_id").alias("sid"), "fate")


FOLDERS = ["src", "node_modules", "a/build", "docs", "x/dist/y", "buildx"]
ENDINGS = [".py", ".js", ".PNG", ".mib", ".md", "", ".lock"]
_PATH_SQL = f"{FOLDERS}[(doc_id % {len(FOLDERS)} + 1)::INTEGER] || '/' || source || {ENDINGS}[(doc_id % {len(ENDINGS)} + 1)::INTEGER]"


def paths(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda names: F.element_at(X.literals(names), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int"))
    return read(spark, folder, "documents").select("doc_id", F.concat(pick(FOLDERS), F.lit("/"), "source", pick(ENDINGS)).alias("path"))


@query(f"""SELECT doc_id, path FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents)
 WHERE NOT list_has_any(string_split(path, '/')[:-2], {T.IGNORED_FOLDERS}) AND NOT list_contains({T.IGNORED_EXTENSIONS}, lower(regexp_extract(path, '([.][^./]+)$', 1)))""")
def code_scan_filter(spark, folder):
    return paths(spark, folder).filter(readers.wanted(F.col("path"), "code")).select("doc_id", "path")


@query(f"""SELECT doc_id, path, CASE WHEN starts_with(path, 'src/src1') AND regexp_matches(path, '^src/src1[^/][.]py(/.*)?$') THEN true WHEN regexp_matches(path, '(^|/)build/') THEN true
 WHEN regexp_matches(path, '(^|/)src2[.]md(/.*)?$') THEN false ELSE regexp_matches(path, '[.]md(/.*)?$') END AS gone FROM (SELECT doc_id, {_PATH_SQL} AS path FROM documents)""")
def gitignore_rules(spark, folder):
    rules = ["# comment", "*.md", "!src2.md", "build/", "/src/src1?.py"]
    return paths(spark, folder).select("doc_id", "path", readers.nested_ignored(F.col("path"), {"": rules}).alias("gone"))


@query("""WITH t AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [{'p': 0, 'i': source}] WHEN 1 THEN [{'p': 0, 'i': doc_id::VARCHAR}, {'p': 1, 'i': lang}] WHEN 3 THEN [{'p': 0, 'i': 'F' || doc_id}] ELSE [] END) AS r FROM documents)
SELECT doc_id, r.p::INTEGER AS position, r.i AS ticket FROM t""")
def json_ticket_rows(spark, folder):
    cases = ['{"FormattedID":"{source}","Name":"n"}', '[{"id":"{doc_id}"},{"ID":"{lang}"}]', "no {lang} json", '{"formatted_id":"F{doc_id}"}']
    rows = readers.json_tickets(coded(spark, folder, [("", _format(c)) for c in cases]), "code")
    return rows.filter(~F.map_contains_key("ticket", "Description")).select("doc_id", "position", readers.ticket_id(F.col("ticket")).alias("ticket"))


@query("SELECT doc_id FROM documents WHERE strlen(text) <= 2 * 1024")
def size_limit(spark, folder):
    """The limit of standards documents, in kilobytes where sources have megabytes."""
    rows = read(spark, folder, "documents").select("doc_id", "text", F.lit("rfc").alias("source_type"), F.col("source"))
    return within_limit(rows, unit=1024).select("doc_id")


@query("""SELECT doc_id, '### ' || source || chr(10) || '*Source: ' || doc_id || '*' || chr(10) || chr(10) ||
 CASE WHEN length(t) > 4096 THEN left(t, 4046) || chr(10) || chr(10) || '... (truncated for response size) ...' ELSE t END AS shown
 FROM (SELECT *, trim(text, ' ') AS t FROM documents)""")
def rendered_results(spark, folder):
    docs = read(spark, folder, "documents")
    meta = F.create_map(F.lit("section"), F.col("source"), F.lit("source"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text", F.lit("wiki").alias("source_type"), meta.alias("metadata")).select("doc_id", render.result().alias("shown"))


# extension beyond the reference: event windows


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, folder):
    return streams.tumbling(read(spark, folder, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*)::BIGINT AS n FROM r GROUP BY user_id, k""")
def event_sessions(spark, folder):
    return streams.sessions(read(spark, folder, "events"))


# cutting by expressions


_TICKET_SQL = {
    "name": "'Mail bob' || c_custkey || '@corp.com'",
    "told": "'<p>Box 10.1.' || c_custkey % 200 || '.7 of ' || c_name || ' fails; workaround known</p>'",
    "tags": "c_mktsegment || ' 00:1A:2B:3C:4D:' || lpad((c_custkey % 100)::VARCHAR, 2, '0')",
    "iteration": "'555-123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')",
}
_CLEAN = {k: _nested(f"({v})", T.REDACTIONS) for k, v in _TICKET_SQL.items()}


@query(f"""SELECT c_custkey AS id, {_CLEAN['name']} AS chunk_name, {_CLEAN['tags']} AS tags, {_CLEAN['iteration']} AS iteration, 'US' || c_custkey AS ticket_id, 'true' AS has_workaround,
 {_CLEAN['name']} || chr(10) || chr(10) || trim(regexp_replace({_CLEAN['told']}, '<[^>]+>', ' ', 'g') || chr(10) || chr(10) || 'Resolution:', chr(10)) || chr(10) || chr(10) || 'Discussion:' AS text
 FROM customer""")
def customer_ticket_rows(spark, folder):
    """Tickets of customers: every value is redacted before it becomes text or metadata."""
    number = lambda n, w: F.lpad(F.pmod("c_custkey", F.lit(n)).cast("string"), w, "0")
    ticket = F.struct(
        F.concat(F.lit("US"), "c_custkey").alias("FormattedID"), F.concat(F.lit("Mail bob"), "c_custkey", F.lit("@corp.com")).alias("Name"),
        F.concat(F.lit("<p>Box 10.1."), F.pmod("c_custkey", F.lit(200)), F.lit(".7 of "), "c_name", F.lit(" fails; workaround known</p>")).alias("Description"),
        F.concat("c_mktsegment", F.lit(" 00:1A:2B:3C:4D:"), number(100, 2)).alias("Tags"), F.concat(F.lit("555-123-"), number(10_000, 4)).alias("Iteration"),
    )
    sources = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("source"), F.to_json(ticket).alias("text"))
    rows = cutting.tickets(sources, True, None, [])
    meta = [F.col("chunk_meta")[k].alias(k) for k in ("chunk_name", "tags", "iteration", "ticket_id", "has_workaround")]
    return rows.select(F.col("source").cast("long").alias("id"), *meta, "text")


_OBJECTS = [("Scalar", "INTEGER"), ("Entry", "INTEGER"), ("Table", "SEQUENCE OF X"), ("Map", "INDEX"), ("Old", "INTEGER")]


@query(f"""WITH o AS (SELECT p_partkey, p_size, p_name, unnest({[(n, s) for n, s in _OBJECTS]}) AS o FROM part)
SELECT p_partkey AS id, 'p' || p_partkey || o[1] AS object_name, o[2] AS syntax, 'base ' || p_size AS oid_path, 'M' || p_partkey || '-MIB' AS section,
 CASE o[1] WHEN 'Entry' THEN 'row' WHEN 'Table' THEN 'table' WHEN 'Map' THEN 'table' ELSE 'scalar' END AS object_type, p_name AS told
FROM o WHERE o[1] <> 'Old'""")
def mib_objects(spark, folder):
    """One module a part, with an object of each type and a deprecated one."""
    part = F.col("p_partkey").cast("string")
    defined = [F.concat(F.lit("\np"), part, F.lit(f"{n} OBJECT-TYPE\n  SYNTAX {s}\n  MAX-ACCESS read-only\n  STATUS {'deprecated' if n == 'Old' else 'current'}\n  DESCRIPTION \""),
                        "p_name", F.lit('"\n  ::= { base '), "p_size", F.lit(" }\n")) for n, s in _OBJECTS]
    text = F.concat(F.lit("M"), part, F.lit("-MIB DEFINITIONS ::= BEGIN\n"), *defined, F.lit("END"))
    sources = read(spark, folder, "part").select(part.alias("source"), text.alias("text"))
    rows = cutting.exploded(sources, cutting.mib_pieces(F.col("text"), F.col("source")), [])
    meta = [F.col("chunk_meta")[k].alias(k) for k in ("object_name", "syntax", "oid_path", "section", "object_type")]
    return rows.select(F.col("source").cast("long").alias("id"), *meta, F.regexp_extract("text", 'DESCRIPTION "([^"]*)"', 1).alias("told"))


@query("""WITH b AS (SELECT c_custkey AS id, c_custkey::VARCHAR AS k, c_name AS n, c_mktsegment AS seg FROM customer)
SELECT id, unnest(['class_declaration', 'method_declaration', 'interface_declaration', 'declarations']) AS chunk_type,
 unnest(['C' || k, 'C' || k || '::get' || k, 'I' || k, k]) AS chunk_name,
 unnest(['class C' || k || ' {' || chr(10) || '  // brace { of ' || n || chr(10) || '  int get' || k || '(int a) { if (a > 0) { return 1; } return "}' || seg || '".length(); }' || chr(10) || '}',
  '// brace { of ' || n || chr(10) || 'int get' || k || '(int a) { if (a > 0) { return 1; } return "}' || seg || '".length(); }',
  '/* ' || seg || ' } */' || chr(10) || 'interface I' || k || ' { }', 'package p.' || lower(seg) || ';' || chr(10) || '/* ' || seg || ' } */']) AS text FROM b""")
def code_structures(spark, folder):
    """A source file for every customer, with braces in comments and literals."""
    k = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("package p."), F.lower("c_mktsegment"), F.lit(";\nclass C"), k, F.lit(" {\n  // brace { of "), "c_name", F.lit("\n  int get"), k,
        F.lit('(int a) { if (a > 0) { return 1; } return "}'), "c_mktsegment", F.lit('".length(); }\n}\n/* '), "c_mktsegment", F.lit(" } */\ninterface I"), k, F.lit(" { }\n"),
    )
    rows = cutting.structured(read(spark, folder, "customer").select(k.alias("source"), text.alias("text")), "java", [])
    return rows.select(F.col("source").cast("long").alias("id"), F.col("chunk_meta.chunk_type"), F.col("chunk_meta.chunk_name"), "text")


def _after_last(mark: str, low: int, most: int) -> str:
    zone = f"substring(body, start + {low + 1}, {most - low})"
    return f"CASE WHEN contains({zone}, {mark}) THEN {low} + length({zone}) - strpos(reverse({zone}), reverse({mark})) + 1 END"


@query(rf"""WITH RECURSIVE b AS (SELECT doc_id, body, length(body) AS n FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS body FROM documents)),
w(doc_id, body, n, start, stop, k) AS (
  SELECT doc_id, body, n, 0::BIGINT, CASE WHEN n <= 1000 THEN n ELSE coalesce({_after_last("chr(10) || chr(10)", 200, 1000)}, {_after_last("'. '", 333, 1000)}, 1000) END, 0
  FROM (SELECT *, 0 AS start FROM b WHERE n > 0)
  UNION ALL
  SELECT doc_id, body, n, start, CASE WHEN n - start <= 1000 THEN n ELSE start + coalesce({_after_last("chr(10) || chr(10)", 200, 1000)}, {_after_last("'. '", 333, 1000)}, 1000) END, k
  FROM (SELECT doc_id, body, n, CASE WHEN near > 0 THEN after + near + 1 ELSE after END AS start, k + 1 AS k
        FROM (SELECT *, strpos(substring(body, after + 1, 450), chr(10) || chr(10)) AS near FROM (SELECT *, greatest(start + 1, stop - 150) AS after FROM w WHERE stop < n)))
  WHERE start < n
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS position, regexp_replace(substring(body, start + 1, stop - start), '^\s+|\s+$', '', 'g') AS piece
FROM w WHERE trim(substring(body, start + 1, stop - start), chr(10) || ' ' || chr(9)) <> ''""")
def char_windows(spark, folder):
    """All documents in overlapping windows of at most 1000 characters."""
    docs = read(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return docs.select("doc_id", F.posexplode(cutting.windows(F.col("text"), 1000)).alias("position", "piece"))


# chunkers run in Python on Arrow batches; tests hold them against the plain functions


@query()
def chunked_documents(spark, folder):
    """All documents as markdown sources, cut into pieces."""
    from .operators.chunkers import chunk

    docs = read(spark, folder, "documents")
    sources = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.lit("domain_doc").alias("source_type"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return chunk(sources).select("source", "chunk_index", "text")


@query()
def ingested_chunks(spark, folder):
    """The whole ingestion plan over the documents: chunks, enrichment and offline vectors."""
    from .embed import embed_chunks, hashed_words
    from .plans.ingest import Options, plan

    docs = read(spark, folder, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    sources = docs.select(path.alias("source"), path.alias("rel_path"), F.lit(".txt").alias("ext"), "text")
    chunks = plan(spark, sources, Options(mode="domain", domain="general", registry=REGISTRY))
    return embed_chunks(chunks, hashed_words).select("chunk_id", "source", "chunk_index", "repository", "content_type", "concepts", "embedding")

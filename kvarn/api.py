"""Python API with the names of the service's tools."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import Embedder, hashed_words, with_retry
from .functions.text import title_slug
from .operators import render, search, stats
from .plans import routing
from .plans.ingest import Options, feed, ingest
from .sources.store import ChunkStore


@dataclass
class Knowledge:
    """One store, opened for search."""

    spark: SparkSession
    folder: str
    embed: Embedder = field(default_factory=hashed_words)

    def reconnect(self) -> Knowledge:
        self.spark.catalog.clearCache()
        return self

    def _chunks(self, domain: str = "general", search_type: str = "auto") -> DataFrame:
        rows = ChunkStore(self.spark, self.folder).chunks().withColumn("sid", F.col("chunk_id"))
        return rows.filter(routing.in_domain(F.col("collection"), domain) & routing.for_search(F.col("collection"), search_type))

    def index(self) -> search.Bm25Index:
        """The term index of the store's current version: built and saved once, then read."""
        store = ChunkStore(self.spark, self.folder)
        path = f"{store.folder}/bm25-{store.version()}"
        if not store.exists(f"bm25-{store.version()}/terms/_SUCCESS"):
            search.Bm25Index.build(store.chunks().withColumn("sid", F.col("chunk_id"))).save(path)
        return search.Bm25Index.load(self.spark, path)

    def vectors(self) -> search.VectorIndex:
        """The cells of the store's current version: filed once, then read."""
        store = ChunkStore(self.spark, self.folder)
        path = f"{store.folder}/cells-{store.version()}"
        if not store.exists(f"cells-{store.version()}/cells/_SUCCESS"):
            return search.VectorIndex.build(store.chunks().withColumn("sid", F.col("chunk_id")), path)
        return search.VectorIndex(self.spark, path)

    def search_knowledge(self, query: str, domain: str = "general", search_type: str = "auto", k: object = 5,
                         repository: str | None = None, include_dependents: bool = False, hybrid: bool = True) -> DataFrame:
        """The k best chunks, optionally followed by chunks that depend on them; mentions such as @docs choose collections.

        Without a vector for the query (the embedder fails) the search goes by words alone.
        """
        found = {m for m in ("web", "docs", "codebase") if f"@{m}" in query.lower().split()}
        search_type = routing.route_mentions(found, search_type)
        query = " ".join(w for w in query.split() if w.lower() not in {f"@{m}" for m in found})
        n, everything = routing.clamp_k(k), self._chunks(domain, search_type)
        rows = everything.filter(F.col("repository") == repository) if repository else everything
        vector = with_retry(self.embed, [query], tries=2, wait=0.0)[0]
        wanted = routing.in_domain(F.col("collection"), domain) & routing.for_search(F.col("collection"), search_type)
        keep = rows.select("sid") if repository else None
        if vector is None:
            ranked = self.index().only(wanted).search(query, routing.candidate_cap(n), keep)
            found = ranked.orderBy(F.desc("bm25"), "collection", "sid").limit(n).select("collection", "sid", "bm25")
        elif hybrid and query.strip():
            near = self.vectors().search(vector, routing.candidate_cap(n), wanted, keep)
            found = search.hybrid(rows, self.index().only(wanted), query, vector, n, keep=keep, near=near).select("collection", "sid", "rrf")
        else:
            near = self.vectors().search(vector, n, wanted, keep)
            found = near.orderBy("distance", "collection", "sid").limit(n).select("collection", "sid", "distance")
        hits = rows.join(F.broadcast(found), ["collection", "sid"])  # found has at most k rows
        if search_type == "troubleshoot":
            hits = hits.filter(routing.troubleshoot_only(F.col("content_type")))
        if not include_dependents:
            return hits
        named = hits.select(F.try_element_at("extra", F.lit("relative_path")).alias("relative_path"), F.try_element_at("extra", F.lit("chunk_name")).alias("chunk_name"))
        more = search.dependents(rows, search.stems(named), 2 * n)
        return hits.unionByName(more.join(hits.select("sid"), "sid", "left_anti"), allowMissingColumns=True)

    def search_codebase(self, query: str, domain: str = "general", k: object = 5) -> DataFrame:
        return self.search_knowledge(query, domain, "code", k)

    def search_concepts(self, concept: str, domain: str = "") -> DataFrame:
        rows = ChunkStore(self.spark, self.folder).chunks().withColumn("sid", F.col("chunk_id"))
        named = F.contains(F.lower("collection"), F.lit(domain.lower())) if domain else F.lit(True)
        return search.by_concept(rows.filter(named), concept)

    def remember(self, notes: DataFrame, domain: str = "general", storage: str = "domain_docs") -> dict:
        """Keep notes(title, content) as markdown below the store's memory folder and ingest them; a note of a known name replaces it.

        Names are made of titles. A title that leaves no name is an error, and so are two notes of one name: which of them
        would stay is nobody's guess. A null content is an empty note. Returns the record of the ingestion.
        """
        if storage not in ("domain_docs", "wiki"):
            raise ValueError(f"no such storage: {storage}")
        named = notes.select(title_slug(F.col("title")).alias("name"), F.coalesce("content", F.lit("")).alias("value"))
        wrong = named.groupBy("name").count().filter(F.col("name").isNull() | (F.col("name") == "") | (F.col("count") > 1)).limit(1).collect()
        if wrong:
            raise ValueError(f"no name, or one for several notes: {wrong[0]['name']!r}")
        store = ChunkStore(self.spark, self.folder)
        path = f"{store.folder}/memory/{storage}"
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(path)
        rel = F.concat("name", F.lit(".md"))
        rows = named.select(
            F.concat(F.lit(f"{path}/"), rel).alias("source"), F.concat(F.lit(f"{storage}/"), rel).alias("rel_path"), F.lit(".md").alias("ext"),
            F.col("value").alias("text"), F.md5("value").alias("md5"),
        )
        embed = self.embed
        return ingest(self.spark, self.folder, rows, Options(mode="domain", domain=domain, make_embedder=lambda: embed, force=True))

    def notes(self, storage: str = "domain_docs") -> DataFrame:
        """(name, content) of the notes kept."""
        store = ChunkStore(self.spark, self.folder)
        if not store.exists(f"memory/{storage}"):
            return self.spark.createDataFrame([], "name string, content string")
        found = self.spark.read.schema("value string, name string").text(f"{store.folder}/memory/{storage}", wholetext=True)
        return found.select("name", F.regexp_replace("value", r"\n\z", "").alias("content"))

    def feed_domain_doc(self, source: str, text: str, domain: str = "general", mode: str = "auto") -> dict:
        return feed(self.spark, self.folder, source, text, Options(mode=mode, domain=domain))

    def list_repositories(self) -> DataFrame:
        return stats.repositories(self._chunks())

    def get_db_stats(self) -> dict[str, DataFrame]:
        rows = self._chunks().withColumn("ingested", F.col("run_id"))
        return {"collections": stats.status(rows), "concepts": stats.top_concepts(rows, 20), "content_types": stats.content_types(rows)}

    @staticmethod
    def _with_metadata(hits: DataFrame) -> DataFrame:
        base = F.create_map(F.lit("source"), F.col("source"), F.lit("repository"), F.col("repository"), F.lit("dependencies"), F.col("dependencies"))
        return hits.withColumn("metadata", F.map_concat(F.map_filter("extra", lambda k, _: ~k.isin("source", "repository", "dependencies")), base))

    def markdown(self, hits: DataFrame) -> str:
        return render.joined(self._with_metadata(hits), render.result(), "sid").first()["answer"]

    def plain(self, hits: DataFrame) -> str:
        """The compact form: a head line, the place and the text of each hit."""
        return render.joined(self._with_metadata(hits), render.compact(), "sid").first()["answer"]

"""Enrichment of chunks: content type, concepts, dependencies, repository, canonical metadata."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import stash
from . import tables as T
from .text import format_concepts, format_dependencies, literals


def content_type(text: Column, signals: dict[str, list[str]] | None = None) -> Column:
    """The type with most distinct signals in the text; the earlier type wins ties, `general` where there is none."""
    low = F.lower(text)
    table = signals or T.CONTENT_SIGNALS
    scored = F.array(*[
        F.struct(
            F.size(F.filter(literals(words), lambda s: F.contains(low, s))).alias("score"),
            F.lit(-k).alias("rank"),
            F.lit(name).alias("name"),
        )
        for k, (name, words) in enumerate(table.items())
    ])
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["name"]).otherwise("general")


def concepts(text: Column, domain: str, registry: dict[str, dict[str, str]] | None = None) -> Column:
    """Sorted ids of the domain's keywords found in the text, as an array."""
    known = T.DEFAULT_REGISTRY if registry is None else registry
    words = known.get(domain if domain in known else "general", {})
    low = F.lower(text)
    pairs = [F.when(F.contains(low, F.lit(k.lower())), F.lit(v)) for k, v in words.items()]
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*pairs)))) if pairs else none


#: Multiplier of the rolling hash over code points, modulo 2^64.
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _rolled(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of all runs of that many code points), one step from each length to the next."""
    hashes = codes + np.uint64(1)
    for length in range(1, min(longest, len(codes)) + 1):
        if length > 1:
            hashes = hashes[:-1] * _ROLL + codes[length - 1 :] + np.uint64(1)
        yield length, hashes


class _Anchors:
    """Hashes of the keywords' first code points, by their number; a table over mixed bits finds nearly all in one step."""

    def __init__(self, by_length: dict[int, np.ndarray]) -> None:
        self.known = {n: np.sort(h) for n, h in by_length.items() if len(h)}
        self.shift, self.first = {}, {}
        for n, h in self.known.items():
            bits = min(22, max(12, len(h).bit_length() + 5))
            self.shift[n] = np.uint64(64 - bits)
            self.first[n] = np.full(1 << bits, -1, dtype=np.int32)
            self.first[n][self._slots(n, h)] = np.arange(len(h))

    def _slots(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Places in the table; once more multiplied, as the leading bits of short runs' hashes are nearly all the same."""
        return (hashes * _ROLL >> self.shift[n]).view(np.int64)

    def hits(self, codes: np.ndarray, whole: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) where a text holds an anchor; of equal runs shorter than `whole` one place."""
        for n, h in _rolled(codes, max(self.known, default=0)):
            if n not in self.known:
                continue
            known = self.known[n]
            where = self.first[n].take(self._slots(n, h))
            at = np.flatnonzero(where >= 0)
            place, seen = where[at], h[at]
            off = np.flatnonzero(known[place] != seen)
            place[off] = np.minimum(np.searchsorted(known, seen[off]), len(known) - 1)
            sure = known[place] == seen
            at, place = at[sure], place[sure]
            if n < whole and len(at):
                if len(known) > 1 << 16:
                    place = np.unique(place, return_inverse=True)[1]
                last = np.empty(min(len(known), 1 << 16) + len(at), dtype=np.int64)
                last[place] = at
                same = last[place]
                drop = same != at
                for k in range(n):  # equal hashes of different runs stay apart
                    drop &= codes[at + k] == codes[same + k]
                at = at[~drop]
            yield n, at, h[at]


#: Rows that the search for anchors holds before it hands them on, whatever the texts and the keywords.
_ROWS_AT_ONCE = 16_384


def _spots(keys: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    """Places of anchors with the id and domain of their texts."""
    which = keys.take(pa.array([r[0] for r in rows], pa.int64()))
    columns = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.string()))]
    return pa.RecordBatch.from_arrays([which["id"], which["domain"], *columns], ["id", "domain", "size", "hash", "seen"])


def concepts_by_join(
    chunks: DataFrame, registry: DataFrame, key: str = "chunk_id", text: str = "text", anchor: int = 8, words_at_once: int = 4_000_000
) -> DataFrame:
    """Concepts from a registry table (domain, keyword, concept) of any size, joined on rolling hashes of the keywords' beginnings.

    A keyword's anchor is its first `anchor` code points, or all if it has fewer. One pass over a text rolls a hash over all
    runs of each length up to that and keeps the places where an anchor begins; each gives a row with the text from there,
    as far as the longest keyword with that anchor length reaches. These meet the keywords of the same hash and domain in an equality join, where the
    whole keyword is compared. Texts are read once and never shuffled. The anchors' hashes travel with the tasks, eight bytes
    a keyword, words_at_once of them in a pass; a larger registry takes more passes. Null texts and empty keywords hold nothing.
    """
    spark = chunks.sparkSession
    words = registry.filter("keyword <> '' AND concept IS NOT NULL").select("domain", F.lower("keyword").alias("word"), "concept").distinct()
    words = words.withColumn("head", F.substring("word", 1, anchor))

    def hash_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch["head"].to_pylist()
            last = [next(h for n, h in _rolled(_codes(t), len(t)) if n == len(t))[0].astype(np.int64) for t in heads]
            sizes = pa.array([len(t) for t in heads], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["domain"], batch["word"], batch["concept"], sizes, pa.array(last, pa.int64())], ["domain", "word", "concept", "size", "hash"])

    words = stash(words.mapInArrow(hash_heads, "domain string, word string, concept string, size int, hash long"), "keywords")
    heads = words.select("size", "hash").distinct()
    total, longest = heads.count(), words.agg(F.max(F.char_length("word"))).first()[0] or 0
    none = chunks.select(F.col(key), F.lit(None).cast("array<string>").alias("concepts"))
    if not total:
        return chunks.join(none.limit(0), key, "left")
    kind = chunks.schema[key].dataType.simpleString()
    found = None
    for part in range(passes := -(-total // words_at_once)):
        mine = heads if passes == 1 else heads.filter(F.pmod(F.col("hash"), F.lit(passes)) == part)
        held = mine.toPandas()
        anchors = _Anchors({int(n): g["hash"].to_numpy().view(np.uint64) for n, g in held.groupby("size")})

        def places(batches: Iterator[pa.RecordBatch], anchors: _Anchors = anchors) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, rows = batch.select(["id", "domain"]), []  # never the texts: a row each would repeat them
                for k, low in enumerate(batch["low"]):
                    low = low.as_py()
                    for n, at, hashes in anchors.hits(_codes(low), anchor):
                        reach = longest if n == anchor else n  # a shorter anchor is its whole keyword
                        new = {(n, h, low[p : p + reach]) for p, h in zip(at.tolist(), hashes.view(np.int64).tolist())}
                        for row in new:
                            rows.append((k, *row))
                            if len(rows) >= _ROWS_AT_ONCE:
                                yield _spots(keys, rows)
                                rows = []
                if rows:
                    yield _spots(keys, rows)

        given = chunks.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), "domain", F.lower(text).alias("low"))
        spots = given.mapInArrow(places, f"id {kind}, domain string, size int, hash long, seen string")
        hit = spots.join(words, ["domain", "size", "hash"]).filter(F.col("seen").startswith(F.col("word"))).select("id", "concept")
        found = hit if found is None else found.unionByName(hit)
    sets = found.groupBy(F.col("id").alias(key)).agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    return chunks.join(sets, key, "left")


_FAMILY = {
    "py": [".py"],
    "js": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"],
    "c": [".c", ".h", ".cpp", ".cxx", ".cc", ".hpp", ".hxx"],
    "java": [".java"],
    "go": [".go"],
    "rs": [".rs"],
}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _last_part(path: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(F.trim(path), "/"), -1), r"\."), 1)


def python_imports(source: str) -> list[str]:
    """Roots of imported modules and the names imported from them; by pattern where the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        names = [m.split(".")[0] for m in re.findall(r"(?m)^\s*from\s+([\w.]+)\s+import", source)]
        for group in re.findall(r"(?m)^\s*import\s+([\w.,\s]+)", source):
            names += [w.split(".")[0] for w in re.split(r"[,\s]+", group) if w and w not in ("import", "as")]
        return names
    names = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names += [a.name.split(".")[0] for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            names += [node.module.split(".")[0]] if node.module else []
            names += [a.name for a in node.names if a.name != "*"]
    return names


@F.pandas_udf(ArrayType(StringType()))
def _python_imports(sources: pd.Series) -> pd.Series:
    return sources.map(lambda s: python_imports(s or ""))


def dependencies(text: Column, extension: Column, with_python: bool = True) -> Column:
    """Sorted import names by language, as the rendered field. Only Python sources leave the JVM."""
    ext = F.lower(extension)
    js = F.transform(F.flatten(F.array(*[_all(text, p, g) for p, g in T.IMPORT_PATTERNS["js"]])), _last_part)
    blocks = F.concat(*[_all(text, p, g) for p, g in T.IMPORT_PATTERNS["go"]])
    go = F.flatten(F.transform(blocks, lambda b: _all(b, r"\"([^\"]+)\"")))
    (use, use_group), (mod, mod_group) = T.IMPORT_PATTERNS["rs"]
    uses = F.flatten(F.transform(_all(text, use, use_group), lambda u: F.split(u, ",")))
    rust = F.filter(F.transform(uses, lambda u: F.trim(F.element_at(F.split(u, "::"), 1))), lambda u: ~u.isin("self", "super", "crate"))
    rust = F.concat(rust, _all(text, mod, mod_group))
    by_family = {"js": js, "c": _all(text, *T.IMPORT_PATTERNS["c"][0]), "java": _all(text, *T.IMPORT_PATTERNS["java"][0]), "go": go, "rs": rust}
    if with_python:
        by_family["py"] = _python_imports(text)
    none = F.array().cast("array<string>")
    found = reduce(lambda rest, f: F.when(ext.isin(_FAMILY[f]), by_family[f]).otherwise(rest), by_family, none)
    return format_dependencies(found)


def repository(path: Column) -> Column:
    return F.when(F.size(F.split(path, "/")) > 1, F.element_at(F.split(path, "/"), 1)).otherwise("root")


def relative_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), "/")).otherwise(path)


def infer_source_type(given: Column, strategy: Column, rally_id: Column, ticket_id: Column) -> Column:
    """The given type, else a ladder over the chunk strategy and ticket ids."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    low, name = F.lower(F.trim(F.coalesce(given, F.lit("")))), F.lower(F.coalesce(strategy, F.lit("")))
    return (
        F.when(low != "", low)
        .when(name.contains("rfc"), "rfc")
        .when(name.contains("mib"), "mib")
        .when(name.contains("rally") | has(rally_id), "rally")
        .when(has(ticket_id), "customer")
        .when(name.contains("wiki"), "wiki")
        .when(name.contains("community"), "community")
        .when(name.contains("release"), "release_notes")
        .otherwise("code")
    )


def finalize(rows: DataFrame) -> DataFrame:
    """All metadata keys as strings, blanks where a column is missing or null; other columns are dropped."""
    have = set(rows.columns)
    return rows.select(*[
        (F.coalesce(F.col(k).cast("string"), F.lit("")) if k in have else F.lit("")).alias(k) for k in T.METADATA_KEYS
    ])


def parse_ticket_filter(text: str | None) -> dict:
    """Rules of 'severity=1,2 state=Closed priority=high'; keys are lower-cased."""
    rules: dict = {}
    for part in (text or "").split():
        key, eq, value = part.partition("=")
        if eq:
            key = key.strip().lower()
            rules[key] = sorted({v.strip() for v in value.split(",") if v.strip()}) if key == "severity" else value.strip()
    return rules


def matches_ticket_filter(rules: dict, severity: Column, state: Column, priority: Column) -> Column:
    """Severity only counts where the ticket has one; state is equal and priority contained, without case."""
    ok = F.lit(True)
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    if "severity" in rules:
        ok = ok & ((blank(severity) == "") | blank(severity).isin(rules["severity"]))
    if rules.get("state"):
        ok = ok & (F.lower(F.coalesce(state, F.lit(""))) == rules["state"].lower())
    if rules.get("priority"):
        ok = ok & F.contains(F.lower(F.coalesce(priority, F.lit(""))), F.lit(rules["priority"].lower()))
    return ok


def chunk_concepts_field(text: Column, domain: str, registry: dict | None = None) -> Column:
    return format_concepts(concepts(text, domain, registry))

"""Search results as text: one expression per template, ordered concatenation for whole answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fence, language_tag, truncate


def _meta(name: str) -> Column:
    return F.coalesce(F.try_element_at("metadata", F.lit(name)), F.lit(""))


def result(score: Column | None = None) -> Column:
    """A hit (text, source_type, metadata map) as markdown, by source type."""
    kind, text = F.col("source_type"), truncate(F.trim("text"))
    source = F.when(_meta("relative_path") != "", _meta("relative_path")).otherwise(_meta("source"))
    repo, name, deps = _meta("repository"), _meta("chunk_name"), F.trim(_meta("dependencies"))
    line = lambda ok, *parts: F.when(ok, F.concat(*parts))
    distance = F.lit(None).cast("string") if score is None else F.concat(F.lit("**Distance:** "), F.format_string("%.4f", score))
    typed = F.concat(F.lit("**source_type:** "), kind)
    shown = F.when(F.char_length(deps) > 500, F.concat(F.substring(deps, 1, 500), F.lit("…"))).otherwise(deps)
    head = F.concat_ws(
        "\n", distance, typed, line(repo != "", F.lit("**Repo:** "), repo),
        F.concat(F.lit("**File:** "), F.when(repo != "", F.concat(repo, F.lit("/"), source)).otherwise(source)),
        line(name != "", F.lit("**Component:** "), name, F.lit(" ("), _meta("chunk_type"), F.lit(")")),
        line(deps != "", F.lit("**dependencies:** "), shown),
    )
    code = F.concat(F.lit("### Code\n"), head, F.lit("\n\n"), fence(text), language_tag(_meta("extension")), F.lit("\n"), text, F.lit("\n"), fence(text))
    section = F.when(_meta("section") != "", _meta("section")).when(_meta("doc_title") != "", _meta("doc_title")).otherwise("Domain Knowledge")
    domain = F.concat(F.lit("### "), section, F.lit("\n*Source: "), _meta("source"), F.lit("*\n\n"), text)
    titled = F.when(_meta("section_title") != "", F.concat(F.lit(": "), _meta("section_title"))).otherwise("")
    rfc = F.concat(F.lit("### RFC "), _meta("rfc_number"), F.lit(" §"), _meta("section_number"), titled, F.lit("\n\n"), text)
    ident = F.when(_meta("rally_id") != "", _meta("rally_id")).otherwise(_meta("ticket_id"))
    solved = F.when(_meta("has_resolution") == "true", " — Resolution: (see body)").otherwise("")
    named = F.when(name != "", F.concat(F.lit(" "), name)).otherwise("")
    ticket = F.concat(F.lit("### ["), ident, F.lit("]"), named, solved, F.lit("\n\n"), text)
    mib = F.concat(F.lit("### OID: "), _meta("object_name"), F.lit(" ("), _meta("oid_path"), F.lit(") — Description\n\n"), text)
    platform = F.when(_meta("source_platform") != "", _meta("source_platform")).otherwise("unknown")
    thread = F.concat(F.lit("### Source: ["), platform, F.lit("] — "), _meta("source_url"), F.lit("\n\n"), text)
    plain = F.concat(F.lit("### Result\n"), F.concat_ws("\n", distance, typed), F.lit("\n\n"), text)
    return (
        F.when(kind == "code", code).when(kind.isin("domain_doc", "theory", "wiki"), domain).when(kind == "rfc", rfc)
        .when(kind.isin("rally", "customer"), ticket).when(kind == "mib", mib).when(kind == "community", thread).otherwise(plain)
    )


def compact(score: Column | None = None) -> Column:
    """A hit as a short plain block."""
    source = F.when(_meta("relative_path") != "", _meta("relative_path")).otherwise(_meta("source"))
    scored = F.lit("") if score is None else F.coalesce(F.concat(F.lit(" score="), F.format_string("%.4f", score)), F.lit(""))
    head = F.concat(F.lit("["), F.col("source_type"), F.lit("]"), F.coalesce(F.concat(F.lit(" ("), F.col("collection"), F.lit(")")), F.lit("")), scored)
    return F.concat_ws("\n", head, source, F.substring("text", 1, 4096))


def joined(hits: DataFrame, block: Column, order: str, separator: str = "\n\n---\n\n", empty: str = "No matching chunks found.") -> DataFrame:
    """All blocks of a bounded result in order, as one text."""
    rows = hits.select(F.struct(F.col(order).alias("at"), block.alias("says")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda p: p["says"])
    return rows.agg(F.when(F.count("*") > 0, F.array_join(parts, separator)).otherwise(empty).alias("answer"))


def by_type(hits: DataFrame, order: str) -> DataFrame:
    """Concept hits in sections by source type."""
    block = F.concat(F.lit("*("), F.coalesce("collection", F.lit("")), F.lit(")* "), result())
    rows = hits.select("source_type", F.struct(F.col(order).alias("at"), block.alias("says")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda p: p["says"])
    head = F.concat(F.lit("## source_type: **"), F.col("source_type"), F.lit("**\n\n"))
    return rows.groupBy("source_type").agg(F.concat(head, F.array_join(parts, "\n\n")).alias("section")).orderBy("source_type")


def as_json(hits: DataFrame, query: str, mode: str, order: str) -> DataFrame:
    """{query, mode, results} of a bounded result."""
    fields = [c for c in ("text", "score", "source_type", "metadata", "collection") if c in hits.columns]
    rows = hits.select(F.struct(F.col(order).alias("at"), *fields).alias("x"))
    results = F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.at"), F.to_json("x").alias("j")))), lambda p: p["j"])
    body = F.concat(F.lit('{"query":'), F.lit(_quoted(query)), F.lit(',"mode":'), F.lit(_quoted(mode)), F.lit(',"results":['), F.array_join(results, ","), F.lit("]}"))
    return rows.agg(body.alias("answer"))


def _quoted(text: str) -> str:
    import json

    return json.dumps(text)


def messages(system: str, context: Column, question: Column, history: Column) -> Column:
    """Chat messages: system, history, then context and question."""
    row = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    asked = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
    return F.concat(F.array(row("system", F.lit(system))), history, F.array(row("user", asked)))

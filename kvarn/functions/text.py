"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literals(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sanitize(text: Column, extra: Iterable[tuple[str, str]] = (), companies: Iterable[str] = ()) -> Column:
    """Redact addresses, mails, phones, MACs, host names, then extra patterns and company names, in this order."""
    rules = [*T.REDACTIONS, *extra]
    rules += [(rf"(?i)\Q{name.strip()}\E", "[customer]") for name in companies if name and name.strip()]
    return reduce(lambda col, rule: F.regexp_replace(col, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def tokenize(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", source, index.cast("string"), content), 256), 1, 20)


def stable_id(collection: Column, source: Column, index: Column, content: Column) -> Column:
    """Key of a stored chunk: by source and index where both are given, else by a hash of its start."""
    sep = F.lit("\x1f")
    hashed = F.substring(F.sha2(F.substring(F.coalesce(content, F.lit("")), 1, 400), 256), 1, 20)
    named = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(index.cast("string"), F.lit("")) != "")
    return F.when(named, F.concat(collection, sep, source, sep, index.cast("string"))).otherwise(
        F.concat(collection, sep, F.lit("__h__"), sep, hashed)
    )


def concept_parts(field: Column) -> Column:
    """Ids of a concept set in its bar form or the older comma form."""
    cut = F.when(field.startswith("|"), F.split(field, r"\|")).otherwise(F.split(field, ","))
    return F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")


def format_concepts(ids: Column) -> Column:
    kept = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x != "")))
    return F.when(F.size(kept) > 0, F.concat(F.lit("|"), F.array_join(kept, "|"), F.lit("|"))).otherwise("")


def format_dependencies(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x != ""))), ", ")


def truncate(text: Column, limit: int = 4096) -> Column:
    cut = F.concat(F.substring(text, 1, limit - 50), F.lit("\n\n... (truncated for response size) ..."))
    return F.when(F.char_length(text) > limit, cut).otherwise(text)


def fence(text: Column) -> Column:
    return F.when(text.contains("```"), "~~~").otherwise("```")


def language_tag(extension: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(T.LANGUAGE_TAGS), F.lower(extension)), F.lit(""))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[ -/]*[@-~]", "")


def mentions(text: Column) -> Column:
    """Distinct @web, @codebase and @docs mentions, lower-cased and sorted."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"@(web|codebase|docs)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def without_mentions(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?i)@(web|codebase|docs)\b", ""), r"^\s+|\s+$", "")


def sanitize_rewrite(rewritten: Column, raw: Column) -> Column:
    """First line of a model's rewrite without its lead-ins and quotes; the raw query where nothing usable is left."""
    first = F.trim(F.regexp_extract(F.regexp_replace(rewritten, r"^\s+", ""), r"^[^\r\n]*", 0))
    lead = "|".join(rf"\Q{p}\E" for p in T.REWRITE_PREFIXES)
    bare = F.regexp_replace(first, rf"^(?i)(?:(?:{lead})\s*)+", "")
    bare = F.regexp_replace(bare, "^[\"'`]+|[\"'`]+$", "")
    return F.when((F.coalesce(bare, F.lit("")) == "") | (F.char_length(bare) > 500), raw).otherwise(bare)


def tool_call(text: Column) -> Column:
    """JSON text of the first tool call, without code fences."""
    inner = F.trim(F.regexp_extract(text, r"(?s)<tool_call>(.*?)</tool_call>", 1))
    fenced = F.regexp_extract(inner, r"(?s)```(?:json|JSON)?\s*\n?(.*?)\n?\s*```", 1)
    return F.nullif(F.when(fenced != "", F.trim(fenced)).otherwise(inner), F.lit(""))


def task_complete(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?s)<task_complete>(.*?)</task_complete>", 1)
    return F.when(text.contains("<task_complete>") & text.contains("</task_complete>"), F.trim(found))


def safe_path(path: Column, root: Column | str) -> Column:
    """A given path below root without blanks around it, empty and `.` parts; null where a part is `..` or the path is null.

    Backslashes count as slashes and a leading slash does not leave the root. Links are not followed.
    """
    bare = F.replace(F.regexp_replace(path, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(bare, "/"), lambda part: ~part.isin("", "."))
    top = F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    return F.when(~F.array_contains(parts, ".."), F.concat_ws("/", F.concat(F.array(top), parts)))


def blocked_command(command: Column) -> Column:
    low = F.lower(F.trim(command))
    return reduce(lambda a, b: a | b, [low.rlike(p) for p in T.BLOCKED_COMMANDS])


def numbered_lines(text: Column, first: int = 1, last: int | None = None, limit: int = 10_000) -> Column:
    """Lines first..last with right-aligned numbers, capped in length."""
    lines = F.split(text, "\n")
    stop = F.lit(last) if last else F.size(lines)
    shown = F.transform(lines, lambda x, k: F.concat(F.lpad((k + 1).cast("string"), 6, " "), F.lit("| "), x))
    body = F.array_join(F.filter(shown, lambda x, k: (k + 1 >= first) & (k + 1 <= stop)), "\n")
    return F.substring(body, 1, limit)


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def title_slug(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(title, r"[^\w\s-]", "")), r"\s+", "_"), 1, 80)


def wiki_slug(title: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(title, r"\W+", "_"), 1, 80), F.lit(".wiki"))


def diagram_label(block: Column) -> Column:
    """Label of a diagram block from its first token, looking past a mermaid or plantuml fence."""
    lines = F.split(F.regexp_replace(block, r"^\s+|\s+$", ""), "\n")
    head = F.lower(F.trim(F.element_at(lines, 1)))
    fenced = head.startswith("```mermaid") | head.startswith("```plantuml")
    line = F.when(fenced, F.lower(F.trim(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))))).otherwise(head)
    token = F.regexp_replace(F.regexp_extract(line, r"^[^\s{(\[]*", 0), "[:;]+$", "")
    return F.coalesce(F.try_element_at(literal_map(T.DIAGRAM_LABELS), token), F.lit(""))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int"))


def token_limit(model: str | None) -> int:
    return next((n for key, n in T.MODEL_TOKEN_LIMITS.items() if key in (model or "").lower()), T.DEFAULT_TOKEN_LIMIT)


def markdown_targets(model: str | None) -> tuple[int, int]:
    most = 4 * token_limit(model)
    return max(400, most // 3), most


def rfc_targets(model: str | None) -> tuple[int, int]:
    most = max(512, 4 * token_limit(model))
    return max(256, most // 3), most


def is_rfc_file(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)[^/]*rfc\d+[^/]*\.txt$")


def looks_like_rfc(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 800))
    html = head.contains("<html") | head.contains("<!doctype")
    return (F.octet_length(text) >= 200) & ~html & F.exists(literals(T.RFC_MARKERS), lambda m: F.contains(head, m))


def rfc_line_is_diagram(line: Column, compat: bool = False) -> Column:
    """Lines of drawings: box art or rows of digits; with compat also every line indented by three blanks."""
    any_of = lambda patterns: reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])
    art = any_of(T.DRAWING_EDGES) | (line.contains("|") & any_of(T.DRAWING_CORNERS))
    digits = F.trim(line).rlike(T.DRAWING_DIGITS) & (F.length(F.regexp_replace(line, r"\D", "")) >= 4)
    wide = line.rlike(r"^[ \t]{3,}\S") if compat else F.lit(False)
    return (F.trim(line) != "") & (art | digits | wide)


def rfc_numbers(text: Column) -> Column:
    """Sorted distinct numbers of a list such as '793,7680 8200-8210'; a reversed range is an error."""

    def numbers(part: Column) -> Column:
        low = F.substring_index(part, "-", 1).cast("int")
        high = F.substring_index(part, "-", -1).cast("int")
        wrong = F.raise_error(F.concat(F.lit("reversed range "), part)).cast("array<int>")
        return F.when(low > high, wrong).otherwise(F.sequence(low, high))

    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def decode(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


@F.pandas_udf(StringType())
def fuzzy_hint(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    """The block of a text most like the wanted lines, where difflib finds it at least 0.4 alike; else null.

    Blocks have as many lines as what is wanted. levenshtein() orders blocks differently, so this one runs in Python.
    """

    def best(text: str | None, block: str | None) -> str | None:
        lines, size = (text or "").split("\n"), max(1, len((block or "").split("\n")))
        blocks = ["\n".join(lines[k : k + size]) for k in range(max(1, len(lines) - size + 1))]
        matcher = SequenceMatcher(b=block or "", autojunk=False)
        rated = []
        for k, candidate in enumerate(blocks):
            matcher.set_seq1(candidate)
            if matcher.real_quick_ratio() >= 0.4 and matcher.quick_ratio() >= 0.4:
                rated.append((matcher.ratio(), -k))
        top = max(rated, default=(0.0, 0))
        return blocks[-top[1]] if top[0] >= 0.4 else None

    return pd.Series([best(t, w) for t, w in zip(texts, wanted)])

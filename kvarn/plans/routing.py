"""Routing and predicates: which collections a search touches, and metadata filters as Catalyst columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as T

TROUBLESHOOT_TYPES = ("edge_case", "workaround", "bug_report")


def resolve_collection(mode: str, domain: str, override: str | None = None) -> str:
    return override or T.COLLECTION_BY_MODE.get(mode, "{domain}_misc").format(domain=domain)


def collection_of(mode: Column, domain: Column) -> Column:
    """resolve_collection as an expression."""
    cases = F.concat(domain, F.lit("_misc"))
    for name, pattern in T.COLLECTION_BY_MODE.items():
        suffix = pattern.removeprefix("{domain}")
        target = F.concat(domain, F.lit(suffix)) if suffix != pattern else F.lit(pattern)
        cases = F.when(mode == name, target).otherwise(cases)
    return cases


def source_type_of(mode: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in T.SOURCE_TYPE_BY_MODE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mode), F.lit("domain_doc"))


def in_domain(collection: Column, domain: str | None) -> Column:
    """Collections whose name holds the domain; a blank or general domain takes all."""
    wanted = (domain or "").strip().lower()
    return F.lit(True) if wanted in ("", "general") else F.contains(F.lower(collection), F.lit(wanted))


def for_search(collection: Column, search_type: str | None) -> Column:
    """Collections of a search type; all for auto, blank and unknown types."""
    kind = (search_type or "").strip().lower()
    has = lambda s: F.contains(collection, F.lit(s))
    rules = {
        "code": collection.endswith("_code"),
        "domain": has("_domain") | (collection == "theory"),
        "troubleshoot": has("_domain") | has("community") | has("_customer") | has("_internal"),
        "reference": collection.isin("rfc", "theory") | has("_mib") | collection.endswith("_releases"),
    }
    return rules.get(kind, F.lit(True))


def troubleshoot_only(content_type: Column) -> Column:
    return content_type.isin(*TROUBLESHOOT_TYPES)


def where(clause: dict) -> Column:
    """Compile {'field': value}, $eq, $ne, $contains, $and and $or into one predicate."""
    parts = []
    for key, value in clause.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [where(c) for c in value]))
        elif isinstance(value, dict):
            compare = {"$eq": lambda c, v: c.eqNullSafe(v), "$ne": lambda c, v: ~c.eqNullSafe(v), "$contains": lambda c, v: F.contains(c, F.lit(v))}
            parts += [compare[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key).eqNullSafe(value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def clamp_k(k: object, default: int = 5, most: int = 25) -> int:
    try:
        return max(1, min(most, int(k)))
    except (TypeError, ValueError):
        return default


def candidate_cap(k: int, setting: object = None) -> int:
    """Candidates per collection and list: the setting where it is a positive number, else 40 or 4k."""
    try:
        if int(setting) > 0:
            return int(setting)
    except (TypeError, ValueError):
        pass
    return max(40, 4 * k)


def route_mentions(mentions: set[str], search_type: str) -> str:
    return "domain" if "docs" in mentions else search_type


def detect_model(setting: str | None, config: dict | None, dimension: int | None, default: str = "nomic-embed-text") -> str:
    """The embedding model from the setting, the stored configuration or the stored dimension."""
    return (setting or "").strip() or (config or {}).get("embedding_model") or T.MODEL_BY_DIMENSION.get(dimension, default)

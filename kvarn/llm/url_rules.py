"""URL rules by a sort-merge range join: which of a set of (host, path) rules decides on a url.

The labels of a host are written in reverse, each closed by a dot (`www.example.net` is `net.example.www.`), so a
rule for a host and all its subdomains is the interval of the keys that begin with the rule's key. Such intervals are
nested or apart. Urls and rules are dealt into parts by bounds over (key, path), taken from a sample that sets nothing
but the sizes of the parts; a rule goes to every part that its interval meets. Each part is sorted by key and swept
once: a rule opens its interval on a stack, keys beyond it close it, so the stack holds the nested rules around the
present key and nothing else. The paths of one host are a sorted list with links to the prefix they extend, in which a
url finds its longest prefix by bisection. A host with a third of all urls is cut into parts by path, and urls that are
equal in both are dealt to the parts in turn.

The longest rule wins, counted in characters of host and path together; of equally long ones that with the longer
host; a rule that is given with both verdicts blocks.

Nulls and edge cases: a null url, or one without `://`, has an empty host and path; a rule with a null host, path or
verdict is not used; an empty host in a rule fits every url; without rules, or where none fits, the verdict is the
default and the rule is null; a null page_id stays null; repeated rows are judged as often as they occur; empty tables
give an empty result. Only page_id and url are read, so further columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
EVENT = "part int, key string, kind int, path string, page_id long, rule string, verdict string"
RESULT = "page_id long, host string, path string, rule string, verdict string"
Bounds = list[tuple[str, str]]


def host(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark or hash, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def key(name: Column) -> Column:
    """Labels in reverse, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def unkey(text: str) -> str:
    """The host of a key."""
    return ".".join(reversed(text[:-1].split(".")))


def after(prefix: str) -> str | None:
    """The least text beyond all that begin with a prefix; None if there is none."""
    kept = prefix.rstrip(chr(0x10FFFF))
    if not kept:
        return None
    step = ord(kept[-1]) + 1
    return kept[:-1] + chr(0xE000 if 0xD800 <= step < 0xE000 else step)


def url_part(bounds: Bounds, at: tuple[str, str], turn: int) -> int:
    """The part of a url; those that equal several bounds take the parts between them in turn."""
    low, high = bisect_left(bounds, at), bisect_right(bounds, at)
    return low + turn % (high - low + 1)


def rule_parts(bounds: Bounds, prefix: str, start: str) -> Iterator[int]:
    """The parts that may hold a url that a rule fits: its keys' interval, less parts of one host whose paths lie apart."""
    end, stop = after(prefix), after(start)
    last = len(bounds) if end is None else bisect_left(bounds, (end, ""))
    for part in range(bisect_left(bounds, (prefix, "")), last + 1):
        if 0 < part < len(bounds) and bounds[part - 1][0] == bounds[part][0]:
            (_, least), (_, most) = bounds[part - 1], bounds[part]
            if most < start or (stop is not None and least >= stop):
                continue
        yield part


@dataclass
class Frame:
    """The open interval of one host: its rules by path, each with the place of the longest other path that it extends."""

    key: str
    paths: list[str] = field(default_factory=list)
    rules: list[tuple[int, int, str, str]] = field(default_factory=list)
    above: list[int] = field(default_factory=list)

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in ascending order."""
        if self.paths and self.paths[-1] == path:
            if verdict == "block":
                self.rules[-1] = (*self.rules[-1][:3], verdict)
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        self.above.append(at)
        self.paths.append(path)
        self.rules.append((len(rule), len(self.key), rule, verdict))

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.above[at]
        return self.rules[at] if at >= 0 else None


class Sweep:
    """Takes the sorted rules and urls of one part after another; answers each url from the stack of open intervals."""

    def __init__(self, default: str) -> None:
        self.default, self.part, self.stack = default, None, []

    def __call__(self, part: int, key: str, kind: int, path: str, rule: str | None, verdict: str | None) -> tuple[str | None, str] | None:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        if kind == 0:
            if not self.stack or self.stack[-1].key != key:
                self.stack.append(Frame(key))
            self.stack[-1].add(path, rule, verdict)
            return None
        found = [b for frame in self.stack if (b := frame.best(path))]
        return max(found)[2:] if found else (None, self.default)


def _bounds(urls: DataFrame, parts: int, rows: int, sample_per_part: int) -> Bounds:
    """Bounds of about equal parts from a random sample of some dozens of keys a part."""
    if parts < 2 or not rows:
        return []
    share = min(1.0, sample_per_part * parts / rows)
    seen = sorted((r.key, r.path) for r in urls.select("key", "path").sample(share, seed=7).collect())
    return [seen[k * len(seen) // parts] for k in range(1, parts)] if seen else []


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", rows_per_part: int = 1_000_000, sample_per_part: int = 32, parts: int | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url) under rules(host, path, verdict).

    The driver holds the bounds of the parts and the sample they come from, at most some dozens of keys for a million urls.
    """
    spark = pages.sparkSession
    name = F.translate("host", UPPER, LOWER)
    asked = pages.select(F.col("page_id").cast("long"), key(host(F.col("url"))).alias("key"), path(F.col("url")).alias("path"))
    given = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.when(name == "", "").otherwise(key(name)).alias("key"), "path", F.concat(name, "path").alias("rule"), "verdict"
    )
    rows = pages.count()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part))
    bounds = _bounds(asked, parts, rows, sample_per_part)

    def deal_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            at = [url_part(bounds, p, turn + k) for k, p in enumerate(zip(batch["key"].to_pylist(), batch["path"].to_pylist()))]
            turn += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["part", *batch.schema.names])

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths = batch["key"].to_pylist(), batch["path"].to_pylist()
            at = [(part, k) for k in range(batch.num_rows) for part in rule_parts(bounds, keys[k], paths[k])]
            rows = batch.take(pa.array([k for _, k in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in at], pa.int32()), *rows.columns], ["part", *batch.schema.names])

    nothing = F.lit(None).cast("string")
    urls = asked.mapInArrow(deal_urls, "part int, page_id long, key string, path string").withColumns({"kind": F.lit(1), "rule": nothing, "verdict": nothing})
    opened = given.mapInArrow(deal_rules, "part int, key string, path string, rule string, verdict string")
    opened = opened.withColumns({"kind": F.lit(0), "page_id": F.lit(None).cast("long")})
    names = [c.split()[0] for c in EVENT.split(", ")]
    events = urls.select(names).unionByName(opened.select(names)).repartitionById(parts, F.col("part"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Sweep(default)
        for batch in batches:
            columns = {c: batch[c].to_pylist() for c in names}
            out = []
            for part, k, kind, p, page, rule, verdict in zip(*(columns[c] for c in names)):
                answer = step(part, k, kind, p, rule, verdict)
                if answer is not None:
                    out.append((page, unkey(k), p, *answer))
            made = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, [pa.int64(), *[pa.string()] * 4])], [c.split()[0] for c in RESULT.split(", ")])

    return events.sortWithinPartitions("part", "key", "kind", "path").mapInArrow(sweep, RESULT)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = rf"""
WITH r(verdict, host, path) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), u AS (
  SELECT row_number() OVER () AS n, page_id,
         coalesce(translate(regexp_extract(url, '{URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages
), f AS (
  SELECT u.*, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

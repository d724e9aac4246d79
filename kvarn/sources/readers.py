"""Sources as DataFrames: folders, ignore rules, tickets, REST pages, change sets, standards lists."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import subprocess
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import tables as T
from ..functions.text import decode, literals
from ..functions.text import rfc_numbers as parse_rfc_numbers

SOURCE_COLUMNS = ["source", "rel_path", "ext", "size", "mtime", "md5", "text"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def glob_regex(rule: str) -> tuple[str, bool]:
    """A gitignore rule as (regex over relative paths, negated)."""
    negated, rule = rule.startswith("!"), rule.lstrip("!")
    folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    body = re.escape(rule.strip("/"))
    for old, new in ((r"\*\*/", "(?:.*/)?"), (r"/\*\*", "(?:/.*)?"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]")):
        body = body.replace(old, new)
    body = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\", "") + "]", body)
    return ("^" if anchored else "(?:^|/)") + body + ("/.*$" if folder else "(?:/.*)?$"), negated


def ignored(rel_path: Column, rules: Iterable[str]) -> Column:
    """Whether the rules of one ignore file exclude a path; later rules win, a negated rule lets it back in."""
    verdict = F.lit(False)
    for rule in rules:
        if (text := rule.strip()) and not text.startswith("#"):
            pattern, negated = glob_regex(text)
            verdict = F.when(rel_path.rlike(pattern), F.lit(not negated)).otherwise(verdict)
    return verdict


def nested_ignored(rel_path: Column, rules_by_folder: dict[str, list[str]]) -> Column:
    """Whether any folder's ignore file excludes a path below it; an outer exclusion always holds."""
    parts = []
    for folder, rules in rules_by_folder.items():
        below = rel_path if folder in ("", ".") else F.regexp_replace(rel_path, rf"^\Q{folder}\E/", "")
        inside = F.lit(True) if folder in ("", ".") else rel_path.startswith(f"{folder}/")
        parts.append(inside & ignored(below, rules))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def wanted(rel_path: Column, mode: str = "domain") -> Column:
    """Folder and extension rules of a mode."""
    folders = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    clean = ~F.arrays_overlap(folders, literals(T.IGNORED_FOLDERS))
    ext = extension(rel_path)
    if mode == "mib":
        return clean & ext.isin(".mib", ".my")
    return clean & ~ext.isin(T.IGNORED_EXTENSIONS) if mode == "code" else clean


def scan(spark: SparkSession, folder: str, mode: str = "domain", ignore: dict[str, list[str]] | None = None) -> DataFrame:
    """All wanted files below a folder, decoded. Path rules come before any use of contents; nothing is sorted here."""
    base = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), rf"^.*\Q{base.removeprefix('file://').rstrip('/')}\E/", "")
    rows = files.withColumn("rel_path", rel).filter(wanted(F.col("rel_path"), mode))
    if ignore:
        rows = rows.filter(~nested_ignored(F.col("rel_path"), ignore))
    return rows.select(
        F.concat(F.lit(f"{base}/"), F.col("rel_path")).alias("source"), "rel_path", extension(F.col("rel_path")).alias("ext"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.md5("content").alias("md5"), decode(F.col("content")).alias("text"),
    )


def csv_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Ticket rows of a CSV file: trimmed header names, nulls as blanks."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns)).na.fill("")


def csv_rows(sources: DataFrame) -> DataFrame:
    """Sources with every CSV file as one source a row: its ticket as JSON, keyed csv:<file>:<id>; others stay."""
    from pyspark.sql.types import StringType, StructField, StructType

    names = ["source", "rel_path", "ext", "md5", "text"]
    schema = StructType([StructField(n, StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, rel_path, ext, md5, text in zip(*(c.to_pylist() for c in batch.columns)):
                if ext != ".csv":
                    out.append((source, rel_path, ext, md5, text))
                    continue
                for row in csv.DictReader(io.StringIO(text or "")):
                    ticket = {str(k).strip(): v or "" for k, v in row.items() if k is not None and not isinstance(v, list)}
                    shown = json.dumps(ticket, ensure_ascii=False)
                    digest = hashlib.md5(shown.encode("utf-8", "replace")).hexdigest()
                    ident = next((ticket[n] for n in ("FormattedID", "formatted_id", "ID", "id") if ticket.get(n)), digest[:10])
                    out.append((f"csv:{source}:{ident}", rel_path, ext, digest, shown))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 5)], names)

    return sources.select(*names).mapInArrow(run, schema)


def discover_ignores(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The rules of every .gitignore below a folder, by its relative folder; Spark's own readers skip hidden files.

    One glob a level runs in the file system's client, so only ignore files, few and small, reach the driver.
    """
    base, out, level = folder.rstrip("/"), {}, ""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(base).getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(paths(base)).toString().rstrip("/")
    while len(fs.globStatus(paths(f"{base}{level}/*")) or []):
        for status in fs.globStatus(paths(f"{base}{level}/.gitignore")) or []:
            where = status.getPath().getParent().toString().removeprefix(top).strip("/")
            stream = fs.open(status.getPath())
            try:
                out[where] = bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
            finally:
                stream.close()
        level += "/*"
    return out


def git_changes(spark: SparkSession, repository: str, since: str | None) -> tuple[DataFrame | None, str | None]:
    """(changes(path, op) since a commit, the head commit) of a local working copy; no changes table means a full scan.

    The working copy may be a folder of a repository: paths are those below it. Falls back from the three-dot to the
    two-argument form where the histories have no common commit.
    """

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, timeout=120, check=False)
        return done.stdout if done.returncode == 0 else None

    head = (git("rev-parse", "HEAD") or "").strip() or None
    if not since or not head:
        return None, head
    listed = git("diff", "--relative", "--name-status", "--no-renames", "-z", f"{since}...{head}")
    if listed is None:
        listed = git("diff", "--relative", "--name-status", "--no-renames", "-z", since, head)
    if listed is None:
        return None, head
    parts = listed.split("\0")
    return spark.createDataFrame(list(zip(parts[1::2], parts[0::2])), "path string, op string"), head


def json_tickets(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per ticket of an object or a list of objects; text that is no JSON becomes a description."""
    col = F.trim(F.col(text))
    many = F.from_json(F.when(col.startswith("["), col), "array<map<string,string>>")
    one = F.from_json(F.when(col.startswith("{"), col), "map<string,string>")
    fallback = F.array(F.create_map(F.lit("Description"), F.col(text)))
    valid = lambda m: m.isNotNull() & (F.size(m) > 0)
    tickets = F.when(valid(many), many).when(valid(one), F.array(one)).otherwise(fallback)
    return rows.select("*", F.posexplode(tickets).alias("position", "ticket"))


def ticket_id(ticket: Column) -> Column:
    """First filled id field of a ticket map, else a hash of the ticket."""
    names = ["FormattedID", "formatted_id", "ID", "id"]
    filled = [F.nullif(F.try_element_at(ticket, F.lit(n)), F.lit("")) for n in names]
    return F.coalesce(*filled, F.substring(F.md5(F.to_json(ticket)), 1, 10))


def ticket_api_filter(ticket: Column) -> Column:
    """Keep tickets of severity 1-3 that are not tagged duplicate and have a description."""
    get = lambda n: F.coalesce(F.try_element_at(ticket, F.lit(n)), F.lit(""))
    digit = F.nullif(F.regexp_extract(get("Severity"), r"(\d)", 1), F.lit("")).try_cast("int")
    return (F.coalesce(digit, F.lit(0)) <= 3) & ~F.contains(F.lower(get("Tags")), F.lit("duplicate")) & (F.trim(get("Description")) != "")


def page_filter(rows: DataFrame, label: str | None = None, least: int = 200) -> DataFrame:
    """Pages that are current or drafts, carry the label and have a body long enough."""
    ok = (F.col("status").isNull() | F.col("status").isin("current", "draft")) & (F.char_length("body") >= least)
    return rows.filter(ok & F.contains("labels", F.lit(label)) if label else ok)


class Pages(DataSource):
    """Paged REST results as a batch source. The fetch callable is injected.

    With the options `total` and `page_size` each page is a partition. Without a total one partition follows the pages:
    fetch(start, page_size) returns rows of (id, json), or (rows, next start or cursor, None at the end); plain rows
    end with the first page that is not full. As a stream each page is a micro-batch, and the checkpoint knows the next.
    """

    fetch: Callable[[int, int], list[tuple[str, str]]] | None = None

    @classmethod
    def name(cls) -> str:
        return "kvarn_pages"

    def schema(self) -> str:
        return "id string, payload string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PageStream(type(self).fetch, int(self.options.get("page_size", 100)))

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(type(self).fetch, int(self.options.get("total", 0)), int(self.options.get("page_size", 100)))


class _PageReader(DataSourceReader):
    def __init__(self, fetch, total: int, page_size: int) -> None:
        self.fetch, self.total, self.page_size = fetch, total, page_size

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(start) for start in range(0, self.total, self.page_size)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        if self.fetch is None:
            raise RuntimeError("no fetch function: this reader has no network access of its own")
        if partition.value is not None:
            yield from self.fetch(partition.value, self.page_size)
            return
        start = 0
        while start is not None:
            page = self.fetch(start, self.page_size)
            rows, start = page if isinstance(page, tuple) else (page, start + self.page_size if len(page) >= self.page_size else None)
            yield from rows


class _PageStream(SimpleDataSourceStreamReader):
    """One page a micro-batch. The offset is where the next page starts, a number or a cursor, so after a broken fetch the
    stream goes on with the page that failed."""

    def __init__(self, fetch, page_size: int) -> None:
        self.fetch, self.page_size = fetch, page_size

    def initialOffset(self) -> dict:
        return {"next": 0}

    def _page(self, start) -> tuple[list, object]:
        if self.fetch is None:
            raise RuntimeError("no fetch function: this reader has no network access of its own")
        page = self.fetch(start, self.page_size)
        return page if isinstance(page, tuple) else (page, start + self.page_size if len(page) >= self.page_size else None)

    def read(self, start: dict) -> tuple[Iterator[tuple[str, str]], dict]:
        if start["next"] is None:
            return iter(()), start
        rows, following = self._page(start["next"])
        return iter(rows), {"next": following}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, str]]:
        return iter(()) if start == end else iter(self._page(start["next"])[0])


def ticket_sources(rows: DataFrame) -> DataFrame:
    """Fetched tickets(id, payload) as sources: those of severity 1-3 that are no duplicates and have a description."""
    kept = rows.filter(ticket_api_filter(F.from_json("payload", "map<string,string>")))
    key = F.concat(F.lit("rally:"), "id")
    return kept.select(key.alias("source"), key.alias("rel_path"), F.lit(".json").alias("ext"), F.md5("payload").alias("md5"), F.col("payload").alias("text"))


_PAGE_FIELDS = {"page_title": "title", "space": "space", "labels": "labels", "author": "author", "page_url": "url", "last_modified": "last_modified"}


def page_sources(rows: DataFrame, label: str | None = None) -> DataFrame:
    """Fetched wiki pages(id, payload) as sources: current pages with the label, their fields as front matter."""
    fields = ["status", "body", *_PAGE_FIELDS.values()]
    page = F.from_json("payload", ", ".join(f"{f} string" for f in fields))
    told = page_filter(rows.select("id", "payload", page.alias("p")).select("id", "payload", "p.*"), label)
    head = [F.concat(F.lit(f"{k}: "), F.regexp_replace(F.coalesce(F.col(v), F.lit("")), r"\s+", " ")) for k, v in _PAGE_FIELDS.items()]
    text = F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n"), "body")
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("https:page/"), "id"))
    return told.select(key.alias("source"), key.alias("rel_path"), F.lit(".wiki").alias("ext"), F.md5(text).alias("md5"), text.alias("text"))


def changed(sources: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources named as modified in changes(path, op), and the paths named as deleted."""
    modified = sources.join(changes.filter("op <> 'D'"), sources["rel_path"] == changes["path"], "left_semi")
    return modified, changes.filter("op = 'D'").select("path")


def rfc_numbers(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string").select(F.explode(parse_rfc_numbers(F.col("text"))).alias("rfc"))


def listing(rows: DataFrame) -> DataFrame:
    """Directory entries(name, is_dir): folders first, then names without case."""
    return rows.orderBy(F.desc("is_dir"), F.lower("name"), "name")

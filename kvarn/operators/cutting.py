"""Cutting and packing of texts as Catalyst expressions, and the chunkers that need nothing else.

An expression takes a text column and gives an array of pieces; a chunker takes sources(source, text, ...) and gives
arrays of (text, metadata), one row in and no shuffle. Nothing is cut off: what is longer than a piece may be goes on in
further pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import tables as T
from ..functions.text import literal_map, sanitize, strip_html

LONGEST = 12_000


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def bind(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def segments(text: Column, pattern: Column | str) -> Column:
    """What starts at the matches of a pattern, and what stands before the first; blanks around are dropped."""
    ahead = F.concat(F.lit("(?m)(?="), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")"))
    return _filled(F.transform(F.split(text, ahead), strip))


def hard_split(text: Column, most: int) -> Column:
    """Windows of at most `most` characters: up to the last line end, else sentence end, else blank in the second half, else whole."""
    least = max(1, most // 2)
    ends = [(most - 1, r"(?=\n)"), (most - 2, r"\.(?= )"), (most - 1, "(?= )")]
    breaks = [rf".{{{least},{longest}}}{end}" for longest, end in ends if longest >= least]
    windows = "|".join([rf".{{1,{most}}}+\z", *breaks, rf".{{1,{most}}}"])
    return _filled(F.transform(F.regexp_extract_all(strip(text), F.lit(rf"(?s)\s*+({windows})"), F.lit(1)), strip))


def within(parts: Column, most: int) -> Column:
    """Parts, the longer ones split hard."""
    return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) > most, hard_split(p, most)).otherwise(F.array(p))))


def _joined(parts: Column, between: str, fits: Callable[[Column, Column], Column], alone: Callable[[Column], Column] | None = None) -> Column:
    """A fold over (text, ...) or texts: each joins the last piece where the two fit, or opens a new one."""
    text = (lambda p: p["text"]) if alone else (lambda p: p)
    none = F.array().cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        may = (F.size(done) > 0) & (~alone(p) if alone else F.lit(True))
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(between), text(p))))
        return F.when(may & fits(F.when(F.size(done) > 0, last), text(p)), longer).otherwise(F.concat(done, F.array(text(p))))

    return F.aggregate(parts, none, step)


def pack_paragraphs(text: Column, most: int) -> Column:
    """Paragraphs joined by a blank line as long as they fit; a longer one is split hard, and its last part may be joined by the next."""
    paragraphs = _filled(F.transform(F.split(text, r"\n\s*\n"), strip))
    long = lambda p: F.char_length(p) > most
    parts = F.flatten(F.transform(paragraphs, lambda p: F.transform(
        F.when(long(p), hard_split(p, most)).otherwise(F.array(p)), lambda x: F.struct(x.alias("text"), long(p).alias("alone")))))
    return _joined(parts, "\n\n", lambda a, b: F.char_length(a) + 2 + F.char_length(b) <= most, lambda p: p["alone"])


def merge_small(parts: Column, least: int = 200, most: int = LONGEST) -> Column:
    """Join a part that is still shorter than least with its follower, by a blank line, up to most characters."""
    return _joined(parts, "\n\n", lambda a, b: (F.char_length(a) < least) & (F.char_length(a) + F.char_length(b) <= most))


def windows(text: Column, most: int, share: float = 0.15) -> Column:
    """Overlapping windows of at most `most` characters as positions in the text: a window ends after its last paragraph end
    beyond a fifth, else after its last sentence end beyond a third; the next starts a share of the length before that end,
    after a paragraph end where one is near."""
    back, ends = max(64, int(most * share)), [("\n\n", max(64, most // 5)), (". ", most // 3)]
    least = max(1, min(low for _, low in ends) + 2 - back)

    def after_last(view: Column, mark: str, low: int) -> Column:
        zone = F.substring(view, low + 1, most)
        return F.when(zone.contains(mark), low + F.char_length(zone) - F.char_length(F.substring_index(zone, mark, -1)))

    def cut(body: Column, n: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            start = at["start"]
            view = F.substring(body, start + 1, F.lit(most))
            size = F.when(n - start <= most, n - start).otherwise(F.coalesce(*[after_last(view, m, low) for m, low in ends], F.lit(most)))
            return bind(F.struct(view.alias("view"), size.alias("size"), (start + size).alias("end")), lambda w: F.when(start >= n, at).otherwise(F.struct(
                _next(body, n, start, w["end"]).cast("int").alias("start"), F.concat(at["out"], F.array(strip(F.substring(w["view"], F.lit(1), w["size"])))).alias("out"))))

        begin = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))
        steps = F.sequence(F.lit(1), F.ceil(n / least).cast("int") + 1)
        return F.aggregate(steps, begin, step, lambda s: s["out"])

    def _next(body: Column, n: Column, start: Column, end: Column) -> Column:
        after = F.greatest(start + 1, end - back)
        near = F.locate("\n\n", F.substring(body, after + 1, F.lit(3 * back)))
        return F.when(end >= n, n).when(near > 0, after + near + 1).otherwise(after)

    found = bind(strip(text), lambda body: bind(F.char_length(body), lambda n: cut(body, n)))
    return _filled(F.coalesce(found, F.array().cast("array<string>")))


# chunkers


def piece(text: Column, **meta: Column | str) -> Column:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.struct(text.alias("text"), F.create_map(*pairs).cast("map<string,string>").alias("chunk_meta"))


def exploded(rows: DataFrame, pieces: Column, carry: list[str]) -> DataFrame:
    """(source, chunk_index, text, chunk_meta, carry...) of an array of pieces; the index is in the metadata too."""
    out = rows.select("source", *carry, F.posexplode(pieces).alias("chunk_index", "piece"))
    meta = F.map_concat("piece.chunk_meta", F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    return out.select("source", "chunk_index", F.col("piece.text").alias("text"), meta.alias("chunk_meta"), *carry)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def entries(text: Column) -> tuple[Column, Column]:
    """(array of (k, v), rest) of a text with a leading block between `---` lines."""
    closes = F.locate("\n---", text, 4)
    has = text.startswith("---") & (closes > 0)
    lines = F.filter(F.split(F.substring(text, F.lit(4), closes - 4), "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substring(x, F.locate(":", x) + 1, F.char_length(x))), r'^"+|"+$', "").alias("v")
    )
    found = F.when(has, F.transform(lines, pair)).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    rest = F.regexp_replace(F.substring(text, closes + 4, F.char_length(text)), r"\A\n+", "")
    return found, F.when(has, rest).otherwise(text)


def entry(found: Column, name: str, default: str = "") -> Column:
    """The last value of a key."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda e: e["k"] == name), F.lit(-1))["v"], F.lit(default))


def thread_pieces(text: Column, **meta: Column | str) -> Column:
    """A thread whole, or cut at rules and answer headings into pieces of up to 8000 characters."""
    found, body = entries(text)
    bits = F.split(body, r"(?m)(?=^---\s*$|^## Answer|^## Resolution)")
    packed = _joined(bits, "", lambda a, b: F.char_length(a) + F.char_length(b) <= 8000)
    parts = F.when(F.char_length(body) <= 8000, F.array(strip(body))).otherwise(_filled(F.transform(within(packed, 8000), strip)))
    common = {k: entry(found, k) for k in ("source_url", "is_resolved", "has_workaround", "quality_score")}
    common |= {"source_platform": entry(found, "source_platform", "unknown"), "chunk_strategy": "community", "chunk_type": "thread"}
    return F.transform(parts, lambda p: piece(p, **{**common, **meta}))


def threads(rows: DataFrame, carry: list[str]) -> DataFrame:
    return exploded(rows, thread_pieces(F.coalesce("text", F.lit(""))), carry)


def _json_tickets(text: Column) -> Column:
    """The filled objects of a JSON object or list as maps; an empty array for any other text."""
    body = F.trim(text)
    many = F.from_json(F.when(body.startswith("["), body), "array<map<string,string>>")
    one = F.array(F.from_json(F.when(body.startswith("{"), body), "map<string,string>"))
    found = F.coalesce(F.when(body.startswith("{"), one), many, F.array().cast("array<map<string,string>>"))
    return F.filter(found, lambda m: m.isNotNull() & (F.size(m) > 0))


def ticket_maps(text: Column, name: Column) -> Column:
    """The tickets of a text as maps; one that is no JSON is the description of a ticket named after its file."""
    other = F.array(F.create_map(F.lit("FormattedID"), name, F.lit("Name"), name, F.lit("Description"), text))
    return bind(_json_tickets(text), lambda found: F.when(F.size(found) > 0, found).otherwise(other))


def first_of(ticket: Column, names: list[str], default: Column | None = None) -> Column:
    """The first filled field."""
    filled = [F.nullif(F.try_element_at(ticket, F.lit(n)), F.lit("")) for n in names]
    return F.coalesce(*filled, F.lit("") if default is None else default)


def ticket_pieces(ticket: Column, source: Column, customer: bool) -> Column:
    """Title, description, resolution and discussion; a long discussion goes on in pieces of its own.

    Of a customer's ticket every value is redacted before anything is made of it, so nothing else reaches a piece.
    """
    clean = F.transform_values(ticket, lambda _, v: sanitize(v)) if customer else ticket
    return bind(clean, lambda t: _ticket_pieces(t, source, customer))


def _ticket_pieces(ticket: Column, source: Column, customer: bool) -> Column:
    told, solved, talk = (strip_html(first_of(ticket, T.TICKET_TEXTS[n])) for n in ("description", "resolution", "discussion"))
    title, ident = first_of(ticket, T.TICKET_FIELDS["chunk_name"]), first_of(ticket, T.TICKET_FIELDS["rally_id"], source)
    names = {k: v for k, v in T.TICKET_FIELDS.items() if k not in ("chunk_name", "rally_id")}
    meta = {"chunk_strategy": "rally_ticket", "chunk_type": "ticket", **{k: first_of(ticket, v) for k, v in names.items()}}
    meta["artifact_type"] = first_of(ticket, names["artifact_type"], F.lit("artifact"))
    meta["has_resolution"] = F.when(F.trim(solved) != "", "true").otherwise("false")
    if customer:
        own = {k: first_of(ticket, v) for k, v in T.CUSTOMER_FIELDS.items()}
        meta |= {**own, "ticket_id": first_of(ticket, T.CUSTOMER_FIELDS["ticket_id"], source), "chunk_strategy": "customer_ticket", "customer_type": "anonymized"}
    else:
        meta["rally_id"] = ident
    head = strip(F.concat(title, F.lit("\n\n"), told, F.lit("\n\nResolution:\n"), solved))

    def make(text: Column, name: Column) -> Column:
        eased = {"has_workaround": F.when(text.rlike("(?i)workaround|mitigation"), "true").otherwise("false")} if customer else {}
        return piece(text, **{**meta, **eased, "chunk_name": name})

    def parts(whole: Column) -> Column:
        label = lambda k: (k + 1).cast("string")
        more = F.transform(pack_paragraphs(talk, 8000), lambda p, k: make(
            F.concat(F.lit("Discussion ("), ident, F.lit(") part "), label(k), F.lit(":\n"), p), F.concat(ident, F.lit("-disc-"), label(k))))
        opening = F.transform(within(F.array(head), LONGEST), lambda h: make(h, title))
        return F.when(F.char_length(whole) <= 8000, F.array(make(whole, title))).otherwise(F.concat(opening, more))

    return bind(strip(F.concat(head, F.lit("\n\nDiscussion:\n"), talk)), parts)


def tickets(rows: DataFrame, customer: bool, rules: dict | None, carry: list[str]) -> DataFrame:
    """The pieces of all wanted tickets of a source. A customer's text that is no JSON is a thread, redacted as a whole."""
    text, name = F.coalesce("text", F.lit("")), stem(F.col("source"))
    get = lambda t, n: first_of(t, [n, n.lower()])
    wanted = F.filter(ticket_maps(text, name), lambda t: M.matches_ticket_filter(rules or {}, get(t, "Severity"), get(t, "State"), get(t, "Priority")))
    pieces = F.flatten(F.transform(wanted, lambda t: ticket_pieces(t, F.col("source"), customer)))
    if not customer:
        return exploded(rows, pieces, carry)
    is_json = F.size(_json_tickets(text)) > 0
    other = thread_pieces(sanitize(text), chunk_strategy="customer_ticket", ticket_id=name)
    return exploded(rows.filter(is_json), pieces, carry).unionByName(exploded(rows.filter(~is_json), other, carry))


def mib_pieces(text: Column, path: Column, keep_deprecated: bool = False) -> Column:
    """One piece per object definition, deprecated ones left out; the whole file where none is left."""
    head = rf"^([A-Za-z0-9-]+)\s+({T.MIB_OBJECT})\b"
    named = F.regexp_extract(text, r"([\w-]+)\s+DEFINITIONS\s*::=", 1)
    return bind(F.when(named != "", named).otherwise(stem(path)), lambda module: _mib_pieces(text, module, head, keep_deprecated))


def _mib_pieces(text: Column, module: Column, head: str, keep_deprecated: bool) -> Column:
    grab = lambda b, p, g=1: F.trim(F.regexp_extract(b, p, g))
    status = lambda b: grab(b, r"STATUS\s+(\w+)")
    blocks = F.filter(segments(text, rf"^\s*[A-Za-z0-9-]+\s+(?:{T.MIB_OBJECT})\b"), lambda b: b.rlike(head))
    if not keep_deprecated:
        blocks = F.filter(blocks, lambda b: ~F.lower(status(b)).isin("deprecated", "obsolete"))

    def kind(b: Column) -> Column:
        seen = {"kind": grab(b, head, 2), "name": grab(b, head, 1), "block": b}
        out = F.lit(T.MIB_OTHER_TYPE)
        for field, pattern, name in reversed(T.MIB_TYPE_RULES):
            out = F.when(seen[field].rlike(pattern), name).otherwise(out)
        return out

    def make(b: Column, k: Column) -> Column:
        name = grab(b, head, 1)
        found = F.coalesce(F.try_element_at(literal_map(T.MIB_CONCEPTS), F.upper(module)), F.lit(""))
        concepts = F.when((k == 0) & (found != ""), F.concat(F.lit("|"), F.array_join(F.array_sort(F.split(found, ",")), "|"), F.lit("|"))).otherwise("")
        syntax = grab(b, r"(?s)SYNTAX\s+(.+?)\n\s*(?:MAX-ACCESS|ACCESS|STATUS|DESCRIPTION|DISPLAY-HINT)\b")
        meta = {
            "chunk_type": "mib_object", "chunk_name": name, "object_name": name, "oid_path": grab(b, r"::=\s*\{\s*([^\}]+)\}"),
            "syntax": F.substring(syntax, 1, 500), "max_access": grab(b, r"MAX-ACCESS\s+(\S+)"), "status": status(b), "object_type": kind(b),
            "section": module, "chunk_strategy": "mib", "mib_module": module, "concepts": concepts,
        }
        return F.transform(within(F.array(b), LONGEST), lambda x: piece(F.concat(name, F.lit("\n"), x), **meta))

    whole = F.transform(within(F.array(text), 8000), lambda x: piece(x, chunk_type="mib_file", chunk_name=module, chunk_strategy="mib", mib_module=module))
    return bind(blocks, lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(found, make))).otherwise(whole))


def release_pieces(text: Column) -> Column:
    """One piece per version heading with its category and date; what stands before the first is a piece of its own."""
    starts = T.VERSION_HEADING.removeprefix("(?m)")
    version = rf"\A(?:{starts.removeprefix('^').strip('()')})"

    def make(body: Column) -> Column:
        low = F.lower(body)
        category, kind = F.lit("general"), F.lit("general")
        for sign, name, label in reversed(T.RELEASE_KINDS):
            category, kind = F.when(low.contains(sign), name).otherwise(category), F.when(low.contains(sign), label).otherwise(kind)
        heading = F.regexp_extract(body, version, 0)
        is_release = heading != ""
        meta = {
            "chunk_type": F.when(is_release, "release").otherwise("changelog"), "version": F.trim(F.regexp_replace(heading, r"^[#vV \t\n]+", "")),
            "release_date": F.trim(F.regexp_extract(F.substring(body, 1, 2500), T.RELEASE_DATE, 1)), "section_category": F.when(is_release, category).otherwise(""),
            "content_type": F.when(is_release, kind).otherwise(""), "chunk_strategy": "release_notes",
        }
        parts = F.when(F.char_length(body) > 8000, pack_paragraphs(body, 6000)).otherwise(F.array(body))
        return F.transform(parts, lambda p: piece(p, **meta))

    return F.flatten(F.transform(segments(text, starts), make))


def scheme_pieces(text: Column, path: Column) -> Column:
    """One piece per top-level definition."""
    forms = F.filter(segments(text, r"^\s*\(define\b"), lambda f: f.startswith("(define"))
    name = lambda f: F.regexp_replace(F.regexp_extract(f, r"\(define\s+(\S+)", 1), r"^[()]+|[()]+$", "")
    label = lambda f: F.when(name(f) != "", name(f)).otherwise(stem(path))
    return F.flatten(F.transform(forms, lambda f: F.transform(
        within(F.array(f), LONGEST), lambda p: piece(p, chunk_name=label(f), chunk_strategy="scheme", chunk_type="define"))))


def boundaries(extension: Column) -> Column:
    """The pattern of an extension's top-level declarations, null where there is none."""
    return F.try_element_at(literal_map({e: "|".join(p) for e, p in T.CODE_BOUNDARIES.items()}), F.lower(extension))


def code_pieces(text: Column, path: Column, extension: Column) -> Column:
    """Declarations, short ones joined with their followers."""
    parts = within(merge_small(segments(text, boundaries(extension))), LONGEST)
    return F.transform(parts, lambda p: piece(p, chunk_strategy="regex_code", chunk_type="fragment", chunk_name=stem(path)))


#: Source types and code extensions that are cut here; all others need a parser or a recursive splitter.
HERE = ("rally", "customer", "mib", "release_notes", "community")


def route(source_type: Column, extension: Column, text: Column) -> Column:
    """Which chunker a source takes: one of HERE, a grammar of braces, `scheme`, `declarations`, or `python`."""
    marks = F.coalesce(F.regexp_like(text, F.concat(F.lit("(?m)"), boundaries(extension))), F.lit(False))
    shaped = F.try_element_at(literal_map(GRAMMARS), F.lower(extension))
    code = F.when(shaped.isNotNull(), shaped).when((extension == ".scm") & text.rlike(r"(?m)^\s*\(define\b"), "scheme").when(marks, "declarations").otherwise("python")
    return F.when(source_type.isin(*HERE), source_type).when(source_type == "code", code).otherwise("python")


def chunked(sources: DataFrame, carry: list[str], rules: dict | None = None, keep_deprecated: bool = False, kinds: Iterable[str] = (*HERE, "code")) -> list[DataFrame]:
    """The pieces of all sources(source, source_type, route, text, carry...) of some source types whose route is not `python`."""
    text, path = F.coalesce("text", F.lit("")), F.col("source")
    ext = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    makers = {
        "rally": lambda rows: tickets(rows, False, rules, carry), "customer": lambda rows: tickets(rows, True, rules, carry),
        "community": lambda rows: threads(rows, carry), "mib": lambda rows: exploded(rows, mib_pieces(text, path, keep_deprecated), carry),
        "release_notes": lambda rows: exploded(rows, release_pieces(text), carry), "scheme": lambda rows: exploded(rows, scheme_pieces(text, path), carry),
        "declarations": lambda rows: exploded(rows, code_pieces(text, path, ext), carry),
    }
    makers |= {g: lambda rows, g=g: structured(rows, g, carry) for g in _TYPES}
    wanted = [*(k for k in HERE if k in kinds), *(("scheme", "declarations", *_TYPES) if "code" in kinds else ())]
    return [makers[k](sources.filter(F.col("route") == k)) for k in wanted]


def restored(window: Column, drawings: Column) -> Column:
    """A window with its placeholders turned back into drawings."""
    numbered = F.transform(drawings, lambda d, k: F.struct(d.alias("d"), F.concat(F.lit("__DIAGRAM_"), k.cast("string"), F.lit("__")).alias("mark")))
    return F.aggregate(numbered, window, lambda w, x: F.replace(w, x["mark"], x["d"]))


def windowed(pieces: DataFrame, most: int, carry: list[str]) -> DataFrame:
    """Pieces of chunk type `sliding_window`, each the whole text of its source, cut into windows; others stay as they are."""
    drawings = F.coalesce(F.from_json(F.try_element_at("chunk_meta", F.lit("drawings")), "array<string>"), F.array().cast("array<string>"))
    plain = F.map_filter("chunk_meta", lambda k, _: ~k.isin("drawings", "chunk_index", "contains_diagram"))
    held = lambda w: F.when(w.rlike(r"__DIAGRAM_\d+__") & (F.size(drawings) > 0), "true").otherwise("false")
    cut = F.transform(windows(F.col("text"), most), lambda w: F.struct(
        restored(w, drawings).alias("text"), F.map_concat(plain, F.create_map(F.lit("contains_diagram"), held(w))).alias("chunk_meta")))
    slides = F.coalesce(F.try_element_at("chunk_meta", F.lit("chunk_type")) == "sliding_window", F.lit(False))
    return pieces.filter(~slides).unionByName(exploded(pieces.filter(slides), cut, carry))



# structure of C, C++ and Java, from braces alone

#: Comments, preprocessor lines and literals, which hide braces; braces and semicolons; and all else.
_TOKENS = (
    r"(?sm)/\*.*?\*/|//[^\n]*|^[ \t]*#[^\n]*|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|[{};]|[^/\"'{};#\n]+|."
)
_TYPES = {"c": "struct|enum", "cpp": "class|struct|enum", "java": "class|interface"}
_TYPE_NAMES = {"java": "_declaration"}
_CONTROL = "if|for|while|switch|catch|synchronized|return|else|do|try|sizeof|new"
GRAMMARS = {".c": "c", ".h": "c", ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".java": "java"}


def blocks(rows: DataFrame, grammar: str) -> DataFrame:
    """(source, start, stop, kind, name) of the types and functions of rows(source, text), as character positions.

    Tokens are numbered and summed over a file: the running sum of braces is the depth, and of the braces of one depth each
    opening one is closed by the next. What stands between two braces or semicolons is the head of a block; literals and
    comments in it count as blanks. A block in a function is part of it.
    """
    text = F.regexp_extract_all("text", F.lit(_TOKENS), F.lit(0))
    tokens = rows.select("source", F.posexplode(text).alias("k", "token"))
    hidden = F.col("token").rlike(r"\A(?:/\*|//|\"|'|[ \t]*#)") & (F.char_length("token") > 1)
    size = F.char_length("token")
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0))
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    placed = tokens.withColumns({
        "at": before(size), "part": before(F.col("token").isin("{", "}", ";").cast("int")), "depth": before(step),
        "code": F.when(hidden, F.repeat(F.lit(" "), size)).otherwise(F.col("token")),
    })
    parts = placed.groupBy("source", "part").agg(
        F.min("at").alias("start"), F.max(F.struct("k", "token", "at", "depth")).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]), "").alias("head"),
    )
    opens = F.col("last.token") == "{"
    level = F.when(opens, F.col("last.depth")).otherwise(F.col("last.depth") - 1)
    same = Window.partitionBy("source", "level").orderBy("part")
    paired = parts.filter(F.col("last.token").isin("{", "}")).withColumn("level", level).withColumn("stop", F.lead("last.at").over(same) + 1)
    head = F.regexp_replace("head", r"\{\z", "")
    kind = F.regexp_extract(head, rf"\b({_TYPES[grammar]})\s+\w+[^()=]*\z", 1)
    typed = F.regexp_extract(head, rf"\b(?:{_TYPES[grammar]})\s+(?:class\s+)?(\w+)", 1)
    called = F.regexp_extract(head, r"([~\w]+(?:::[~\w]+)*)\s*\([^{};]*\)[^(){};=]*\z", 1)
    is_function = (kind == "") & (called != "") & ~called.rlike(rf"\A(?:{_CONTROL})\z") & ~head.rlike(r"=|\bnew\b") & head.rlike(r"\w\s*[*&]*\s+[*&]*\s*[~\w:]+\s*\(|::|~")
    found = F.when(kind != "", F.concat(kind, F.lit(_TYPE_NAMES.get(grammar, "_specifier")))).when(
        is_function, "method_declaration" if grammar == "java" else "function_definition")
    blank = F.char_length(head) - F.char_length(F.regexp_replace(head, r"\A\s+", ""))
    begin = F.when((kind != "") & F.lit(grammar != "java"), F.regexp_instr(head, F.lit(rf"\b(?:{_TYPES[grammar]})\b")) - 1).otherwise(blank)
    return paired.filter(opens & F.col("stop").isNotNull() & found.isNotNull()).select(
        "source", (F.col("start") + begin).alias("start"), "stop", found.alias("kind"), F.when(kind != "", typed).otherwise(called).alias("name"))


def structured(rows: DataFrame, grammar: str, carry: list[str]) -> DataFrame:
    """Types and functions as pieces, nested ones too, under `Type::name`, with up to two comment lines before them.

    What stands outside of all of them follows as pieces of its own; a file without any is cut into fragments.
    """
    function = "method_declaration" if grammar == "java" else "function_definition"
    spans = blocks(rows.select("source", F.coalesce("text", F.lit("")).alias("text")), grammar).groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "name"))).alias("spans"))
    joined = rows.join(spans, "source", "left")
    text, strategy = F.coalesce("text", F.lit("")), {"chunk_strategy": f"ast_{grammar}"}

    def inside(a: Column, b: Column) -> Column:
        return (a["start"] >= b["start"]) & (a["stop"] <= b["stop"]) & ((a["start"] > b["start"]) | (a["stop"] < b["stop"]))

    def make(s: Column, every: Column) -> Column:
        around = F.filter(every, lambda o: inside(s, o) & (o["kind"] != function))
        owner = F.when(F.size(around) > 0, F.concat(F.element_at(around, -1)["name"], F.lit("::"))).otherwise("")
        lead = F.substring(text, F.greatest(F.lit(1), s["start"] - 399), F.least(F.lit(400), s["start"]))
        comment = F.regexp_extract(lead, r"((?:^[ \t]*(?://[^\n]*|/\*[^\n]*\*/)[ \t]*\n){1,2})[ \t]*\z".replace("((?:^", "(?m)((?:^"), 1)
        body = strip(F.concat(comment, F.substring(text, s["start"] + 1, s["stop"] - s["start"])))
        return F.transform(within(F.array(body), LONGEST), lambda p: piece(p, chunk_type=s["kind"], chunk_name=F.concat(owner, s["name"]), **strategy))

    def every(found: Column) -> Column:
        own = F.filter(found, lambda s: ~F.exists(found, lambda f: (f["kind"] == function) & inside(s, f)))
        top = F.filter(own, lambda s: ~F.exists(own, lambda o: inside(s, o)))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("rest"))
        rest = F.aggregate(top, begin, lambda r, s: F.struct(
            s["stop"].cast("long").alias("at"), F.concat(r["rest"], F.substring(text, r["at"] + 1, s["start"] - r["at"])).alias("rest")),
            lambda r: F.concat(r["rest"], F.substring(text, r["at"] + 1, F.char_length(text))))
        others = F.filter(within(F.array(strip(F.regexp_replace(rest, r"\n[\s;]*\n", "\n"))), LONGEST), lambda p: p.rlike(r"\w"))
        outside = F.transform(others, lambda p: piece(p, chunk_type="declarations", chunk_name=stem(F.col("source")), **strategy))
        return F.concat(F.flatten(F.transform(own, lambda s: make(s, own))), outside)

    fragments = F.transform(within(F.array(strip(text)), 2000), lambda p: piece(
        p, chunk_type="fragment", chunk_name=stem(F.col("source")), chunk_strategy="language"))
    pieces = F.when(F.col("spans").isNull(), F.filter(fragments, lambda p: p["text"] != "")).otherwise(bind(F.col("spans"), every))
    return exploded(joined, pieces, carry)

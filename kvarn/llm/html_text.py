"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a line is the text of one block element, and every stripped part (script, menu,
form, advert, ...) outside a marked article, and both ends of such an article, leave a gap of empty lines. Each
line weighs its characters outside links, nothing where most of it is links. The weights are summed over windows of
`window` lines. Where the sums leave zero a stretch begins, where they dive back to zero it ends, and the stretches
in which the sum surges above the threshold are the text. The threshold is `surge` characters, or a quarter of the
page's highest sum where that is less, so short articles surge too. Where one container (div, section, article, main)
holds at least half of what was found, its other lines between its first and its last line outside links belong to the
text as well: a short closing paragraph after an advert or a list of links does not surge by itself.

A mark (article, main, role=main, articleBody) is evidence, not the answer: with a share s of the page's text inside
marks, lines inside weigh 1 / (1 - s) times and lines outside (1 - s) times their characters. A mark around nearly all
text silences the rest; a marked teaser beside a long body does not.

Nulls and edge cases: a null or empty page, or one without text, gives an empty text; unclosed tags, comments and
scripts end with the page; a tag cut off by the end of the page is markup; unknown character references stay as
they are; repeated rows give one row each; an empty table gives an empty result. Pages are never shortened. Only
the id, url and html columns are read, so further columns may have any name.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|canvas|title|head(?!er))\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small"
    " span strike strong sub sup time tt u var wbr input source track".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("div section article main".split())
_DROPPED = frozenset("nav footer aside form menu dialog button fieldset audio video map".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter"
    r"|subscribe|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|share|sharing|social"
    r"|related|recommended|widget|login|signup)(?:$|[\s_-])",
    re.I,
)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|respond|disqus\w*|discussion|replies)(?:$|[\s_-])", re.I)
_CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body)(?:$|[\s_-])", re.I)


def _kind(tag: str, attributes: str, in_main: bool) -> int:
    """1: the article opens here, -1: nothing in here is its text, 0: neither."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{given.get('class', '')} {given.get('id', '')}"
    if tag in _DROPPED or (tag == "header" and not in_main) or given.get("role", "").lower() in _DROPPED_ROLES:
        return -1
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", ""):
        return -1
    if _COMMENT_NAMES.search(names):
        return -1
    if _DROPPED_NAMES.search(names) and tag not in ("article", "main", "body", "html") and not _CONTENT_NAMES.search(names):
        return -1
    if tag in ("article", "main") or given.get("role", "").lower() == "main" or given.get("itemprop") == "articleBody":
        return 1
    return 0


def lines(page: str, window: int) -> list[tuple[str, int, bool, int]]:
    """(text, characters outside links, inside a mark, number of the container or 0) of every line, empty ones for gaps."""
    out: list[tuple[str, int, bool, int]] = []
    containers: list[int] = [0]
    numbered = 0
    stack: list[tuple[str, int]] = []
    open_tags: Counter[str] = Counter()
    text: list[str] = []
    dropped = main = linked = in_link = 0
    gap = [("", 0, False, 0)] * window

    def flush() -> None:
        nonlocal linked
        line = " ".join(htmllib.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, max(0, len(line) - linked), main > 0, containers[-1]))
        linked = 0

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at and not dropped:
            text.append(page[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and not dropped:
                text.append(" ")
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        inline = tag in _INLINE
        if not inline:
            flush()
        if tag in _VOID or (inline and not closing and not attributes):
            continue
        if closing:
            while open_tags[tag]:
                open_tag, kind = stack.pop()
                open_tags[open_tag] -= 1
                if open_tag in _CONTAINERS:
                    containers.pop()
                if kind < 0:
                    dropped -= 1
                    text.clear()
                    if not dropped and not main:
                        out.extend(gap)
                elif kind > 0:
                    flush()
                    main -= 1
                    if not main:
                        out.extend(gap)
                if open_tag == tag:
                    break
        else:
            kind = _kind(tag, attributes, main > 0)
            if inline and kind == 0:
                continue
            if kind < 0:
                flush()
                dropped += 1
            elif kind > 0 and not dropped:
                if not main:
                    out.extend(gap)
                main += 1
            else:
                kind = 0
            if tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or kind:
                stack.append((tag, kind))
                if tag in _CONTAINERS:
                    numbered += 1
                    containers.append(numbered)
                open_tags[tag] += 1
    if at < len(page) and not dropped:
        text.append(page[at:])
    flush()
    return out


def weights(found: list[tuple[str, int, bool, int]]) -> np.ndarray:
    """What each line adds to its windows."""
    own = np.array([len(t) if inside else own if 2 * own >= len(t) else 0 for t, own, inside, _ in found], dtype=float)
    marked = np.array([inside for _, _, inside, _ in found])
    rest = max(0.01, 1 - own[marked].sum() / max(1.0, own.sum()))
    return np.where(marked, own / rest, own * rest)


def main_text(page: str | None, window: int = 3, surge: int = 86) -> str:
    """The stretches of lines that surge, joined by line breaks."""
    found = lines(page or "", window)
    if not found:
        return ""
    weight = weights(found)
    sums = np.convolve(weight, np.ones(window))[window - 1 :]  # of each line and those after it
    threshold = min(surge, sums.max() / 4)
    filled, dives = np.flatnonzero(weight), np.r_[np.flatnonzero(sums <= 0), len(found)]
    kept, k = np.zeros(len(found), dtype=bool), 0
    while k < len(filled):
        start = int(filled[k])
        end = int(dives[np.searchsorted(dives, start)])
        if sums[start:end].max() > threshold:
            kept[start:end] = True
        k = int(np.searchsorted(filled, end))
    container = np.array([number for *_, number in found])
    held = np.bincount(container, weight * kept)
    for number in np.flatnonzero((2 * held >= held.sum()) & (held > 0)):
        own = np.flatnonzero((container == number) & (weight > 0))
        if number:
            kept[own[0] : own[-1] + 1] |= container[own[0] : own[-1] + 1] == number
    return "\n".join(text for (text, *_), keep in zip(found, kept) if text and keep)


def extract(pages: DataFrame, window: int = 3, surge: int = 86) -> DataFrame:
    """(page_id, url, text, n_chars): one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), window, surge) for page in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages that mark their article, as those of the test tables do: the text of its block elements.
SQL = r"""
WITH body AS (
  SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|\z)', 1), '<[^>]*$', '') AS h FROM pages
), lines AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(h, '</?(?:p|h1)>'), lambda b: trim(regexp_replace(
    replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&amp$', '&'),
    '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM body
)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10)))::BIGINT AS n_chars FROM lines
"""

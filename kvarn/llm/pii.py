"""Personal data in texts, found on an offset-preserving normal form.

Plain identifiers are found by four fixed patterns on the text as it is. Disguised ones are found after a chain
of transducers has rewritten the text: width, accent-free look-alikes of Latin letters and digits, zero-width
characters, "(at)", "[dot]" and spelled digits. Each transducer carries, for every character it emits, the span
of source characters it stands for, so a match in the normal form is mapped back to the source. Spans that the
plain patterns found always stay; a mapped span is added only where it overlaps none of them and where its
source really was disguised.

Nulls and edge cases: a null or empty text has no spans (the checksum is that of the empty string); a match that
fails its check (range, Luhn, digits) is dropped and not tried again from a later start; repeated rows give one
row each; rows with a null id are scanned like any other; an empty table gives an empty result. Texts are scanned
whole. Only the id and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import frugal, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

#: Fixed patterns. Possessive runs and look-behinds keep them linear; the matches are those of the plain forms.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of a local part, @ and a dotted domain; every @ is tried once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    out = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(m.span())
    return out


_FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    """Plain identifiers of each kind."""
    return {kind: find(text) for kind, find in _FINDERS.items()}


#: Letters of other scripts that look like Latin letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "А": "A", "В": "B",
    "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I",
    "Ј": "J", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_EXOTIC = re.compile("[^\x00-\x7e\u00a1-\u00ac\u00ae-\u0130\u0132-\u024f]")
#: Spelled digits.
_DIGITS = {w: str(d) for d, names in enumerate((
    "zero oh null cero zéro", "one uno un eins", "two dos deux zwei", "three tres trois drei", "four cuatro quatre vier",
    "five cinco cinq fünf", "six seis sechs", "seven siete sept sieben", "eight ocho huit acht", "nine nueve neuf neun",
)) for w in names.split()}
_NAMED = "|".join(sorted(_DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAMED}|[0-9]+|\+|plus)(?:[\s,.-]{{1,3}}(?:{_NAMED}|[0-9]+)(?!\w)|(?<=\+)(?:{_NAMED}|[0-9]+)(?!\w))*", re.I)
_NAME = re.compile(rf"(?<!\w)(?:{_NAMED}|plus)(?!\w)", re.I)
_GAP = re.compile(r"(?<=[0-9+])[\s,.-]{1,3}(?=[0-9])")
#: Words that stand for a dot or an at sign.
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_AT_WORDS = ("at", "arroba")
_DOT_WORD, _AT_WORD = "|".join(_DOT_WORDS), "|".join(_AT_WORDS)
_BRACKETED = re.compile(rf"[(\[{{<]\s{{0,3}}(?:{_DOT_WORD}|{_AT_WORD}|[@.])\s{{0,3}}[)\]}}>]", re.I)
_AT = re.compile(rf"[(\[{{<]\s{{0,3}}(?:{_AT_WORD}|@)\s{{0,3}}[)\]}}>]|(?<=\s)(?:{_AT_WORD})(?=\s)|@", re.I)
_DOT = rf"(?:\s{{0,3}}[(\[{{<]\s{{0,3}}(?:{_DOT_WORD}|\.)\s{{0,3}}[)\]}}>]\s{{0,3}}|\s{{1,3}}(?:{_DOT_WORD}|\.)\s{{1,3}}|\.)"
_ANY_DOT = re.compile(_DOT, re.I)
_BEFORE, _AFTER = re.compile(rf"{_DOT}\Z", re.I), re.compile(_DOT, re.I)
_LOCAL_RUN = re.compile(r"[A-Za-z0-9_%+-]+")
_TAIL = re.compile(rf"\s{{0,3}}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I)
_DOTTED = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?!\w)", re.I)
_MISREAD = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_OCR = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]++(?:[\x20().-]{1,3}[0-9OolI]++)*+")
#: A dot mark is at most this long: three blanks, bracket, three blanks, word, and the same again.
_MARK_ROOM = 24


def local_start(text: str, floor: int, end: int) -> int:
    """Where the disguised local part that ends at `end` begins, or `end` if there is none; walks back by whole parts."""
    at = end
    while at > floor and end - at < 3 and text[at - 1].isspace():
        at -= 1
    start = end
    while True:
        word = at
        while word > floor and _LOCAL_RUN.match(text[word - 1]):
            word -= 1
        if word == at:
            return start
        start = word
        mark = _BEFORE.search(text[max(floor, word - _MARK_ROOM) : word])
        if not mark:
            return start
        at = word - len(mark[0])


class Tape:
    """A text and where it comes from: the tape before, and the edits that led here. Memory goes with the edits alone."""

    def __init__(self, text: str, before: Tape | None = None, edits: list[tuple[int, int, str]] | None = None) -> None:
        self.text, self.before, self.edits = text, before, edits or []
        self.places, shift = [], 0  # where each edit's new text starts
        for a, b, new in self.edits:
            self.places.append(a + shift)
            shift += len(new) - (b - a)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace [start, end) by other text; each new character stands for the whole of what it replaces."""
        if not edits:
            return self
        text, at = [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            at = b
        return Tape("".join(text) + self.text[at:], self, edits)

    def _one(self, at: int) -> Span:
        """What the character at `at` stands for in the text before."""
        k = bisect_right(self.places, at) - 1
        if k < 0:
            return at, at + 1
        (a, b, new), past = self.edits[k], at - self.places[k]
        return (a, b) if past < len(new) else (b + past - len(new), b + past - len(new) + 1)

    def source(self, start: int, end: int) -> Span:
        """The span of the first text that [start, end) stands for."""
        tape = self
        while tape.before is not None:
            start, end = tape._one(start)[0], tape._one(end - 1)[1]
            tape = tape.before
        return start, end


def fold_characters(tape: Tape) -> Tape:
    """Drop invisible characters, fold widths, styles and look-alikes to plain Latin letters and digits."""
    edits = []
    for k, c in enumerate(tape.text):
        if c > "~" and not ("\u00a1" <= c < "\u0250" and c not in "\u00ad\u0131"):
            if _INVISIBLE.match(c):
                edits.append((k, k + 1, ""))
                continue
            new = _LOOKALIKES.get(c)
            if new is None and c not in " ":
                folded = unicodedata.normalize("NFKC", c)
                new = "".join(_LOOKALIKES.get(x, x) for x in folded)
                if c.isdecimal():
                    new = str(unicodedata.decimal(c))
                if not new.isascii():
                    continue
            if new is not None and new != c:
                edits.append((k, k + 1, new))
    return tape.rewrite(edits)


def spell_out(tape: Tape) -> Tape:
    """Write runs of spelled digits as digits, and single ones next to a dot mark; other number words stay words."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        words = list(_NAME.finditer(tape.text, *m.span()))
        marked = _BEFORE.search(tape.text[max(0, m.start() - 12) : m.start()]) or _AFTER.match(tape.text, m.end())
        if len(words) < (1 if marked else 2):
            continue
        run = [(w.start(), w.end(), "+" if w[0].lower() == "plus" else _DIGITS[w[0].lower()]) for w in words]
        edits += sorted(run + [(g.start(), g.end(), "") for g in _word_gaps(tape.text, *m.span())])
    return tape.rewrite(edits)


def _word_gaps(text: str, start: int, end: int) -> Iterator[re.Match]:
    """Separators next to a number word; those between plain digits stay."""
    for g in re.compile(r"[\s,.-]{1,3}").finditer(text, start, end):
        if not (text[g.start() - 1].isdigit() and text[g.end() : g.end() + 1].isdigit()):
            yield g


def join_marks(tape: Tape) -> Tape:
    """Write disguised at and dot marks inside an address, and dots inside four numbers, as characters."""
    text, edits, done = tape.text, [], 0
    for at in _AT.finditer(text):
        tail = _TAIL.match(text, at.end())
        if not tail or at.start() < done:
            continue
        a = local_start(text, done, at.start())
        head = text[a : at.start()]
        if not head.strip():
            continue
        if at[0].lower() in _AT_WORDS and not re.search(r"[(\[{<\s]", tail[0].strip()):
            continue  # "meet me at example.com" is prose
        edits += [(a + d.start(), a + d.end(), ".") for d in _ANY_DOT.finditer(head)]
        left, right = len(head) - len(head.rstrip()), len(tail[0]) - len(tail[0].lstrip())
        edits.append((at.start() - left, at.end() + right, "@"))
        edits += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(text, at.end() + right, tail.end())]
        done = tail.end()
    for m in _DOTTED.finditer(text):
        if re.search(r"[A-Za-z\[({<]", m[0]):
            edits += [(d.start(), d.end(), ".") for d in _ANY_DOT.finditer(text, *m.span())]
    clean, end = [], 0
    for e in sorted(edits):
        if e[0] >= end and text[e[0] : e[1]] != e[2]:
            clean.append(e)
            end = e[1]
    return tape.rewrite(clean)


def mend_digits(tape: Tape) -> Tape:
    """Read O and l among digits as 0 and 1."""
    text, edits = tape.text, []
    for m in _OCR.finditer(text):
        shown = m[0]
        if text[m.end() : m.end() + 1].isalnum():  # the last part belongs to a word
            shown = shown[: max(map(shown.rfind, " ().-")) + 1]
        odd = sum(map(shown.count, "OolI"))
        if odd and sum(map(str.isdigit, shown)) >= 2 * odd + 4:
            edits += [(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for k, c in enumerate(shown) if c in "OolI"]
    return tape.rewrite(edits)


def normal_form(text: str) -> Tape:
    """The transducers that the text needs, in turn."""
    tape = Tape(text)
    if _EXOTIC.search(text) or _INVISIBLE.search(text):
        tape = fold_characters(tape)
    low = tape.text.lower()
    if not _DIGITS.keys().isdisjoint(low.replace(",", " ").replace("-", " ").replace(".", " ").split()):
        tape = spell_out(tape)
    if "@" in low or any(w in low for w in (*_DOT_WORDS, "arroba")) or _BRACKETED.search(low):
        tape = join_marks(tape)
    if _MISREAD.search(tape.text):
        tape = mend_digits(tape)
    return tape


def all_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The base spans, and those that only the normal form shows."""
    tape = normal_form(text)
    if tape.text == text:
        return base
    taken = [(a, b, kind) for kind, spans in base.items() for a, b in spans]
    out = {}
    for kind in KINDS:
        spans = list(base[kind])
        for start, end in _FINDERS[kind](tape.text):
            a, b = tape.source(start, end)
            met = [t for t in taken if a < t[1] and t[0] < b]
            wider = all(t[2] == kind and a <= t[0] and t[1] <= b and (a, b) != t[:2] for t in met)
            if text[a:b] != tape.text[start:end] and wider:
                spans.append((a, b))
                taken.append((a, b, kind))
        out[kind] = sorted(spans)
    return out


def render(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def mask(text: str | None) -> str | None:
    """The text with every span, plain or disguised, replaced by the name of its kind in brackets."""
    if not text:
        return text
    found = sorted((a, b, kind) for kind, spans in all_spans(text, base_spans(text)).items() for a, b in spans)
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += (text[at:a], f"[{kind}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): plain counts and checksum, all spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                plain = render(base)
                spans = all_spans(text, base)
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), render(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema)


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of the text masked; all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([mask(t.as_py()) for t in batch.column(at)], pa.string())
            yield batch.set_column(at, "text", texts)

    return docs.mapInArrow(frugal(run), docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))

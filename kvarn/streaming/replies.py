"""What of a model's reply may be shown while it is still arriving: text before its first control tag.

A reply is shown up to the first opening of a control tag (`<tool_call`, `<task_complete`) outside of fenced code; from
there on nothing is. A line that begins with three backticks opens or closes a fence once it is complete; inside, tags are
text like any other. What could still become a tag at the end of a reply is not shown. None of this depends on where a
reply is cut into tokens. A fence that opens inside a control tag does not bring the tag back.

`shown` says it of whole replies as an expression. `follow_replies` says it of a stream of tokens with a state of bounded
size per reply: the fence, the first characters of the line, and the few characters that may be the beginning of a tag.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.tables import CONTROL_TAGS

FENCE = "```"
_PARTS = sorted((tag[:n] for tag in CONTROL_TAGS for n in range(1, len(tag))), key=len, reverse=True)


def shown(text: Column) -> Column:
    """The part of a whole reply that is shown; null stays null."""
    found = lambda line: reduce(F.least, [F.coalesce(F.nullif(F.locate(tag, line), F.lit(0)), F.lit(2**31 - 1)) for tag in CONTROL_TAGS])
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("fenced"), F.lit(False).alias("before"), F.lit(-1).alias("cut"))

    def step(acc: Column, line: Column) -> Column:
        hit = ~acc["fenced"] & (acc["cut"] < 0) & (found(line) < 2**31 - 1)
        return F.struct(
            (acc["at"] + F.char_length(line) + 1).alias("at"),
            (acc["fenced"] != F.ltrim(F.translate(line, "\t\r", "  ")).startswith(FENCE)).alias("fenced"),
            acc["fenced"].alias("before"),
            F.when(hit, acc["at"] + found(line) - 1).otherwise(acc["cut"]).alias("cut"),
        )

    end = F.aggregate(F.split(text, "\n"), start, step)
    part = F.regexp_replace(text, rf"(?:{'|'.join(_PARTS)})\z", "")
    return F.when(end["cut"] >= 0, F.substring(text, F.lit(1), end["cut"])).when(end["before"], text).otherwise(part)


class Reading(NamedTuple):
    """Where the reading of a reply stands: number of the token awaited, fence, first characters of the line, held text,
    whether a tag ended it, and how many tokens came early."""

    awaited: int = 0
    fenced: bool = False
    head: str = ""
    held: str = ""
    over: bool = False
    early: int = 0


def read_token(now: Reading, token: str) -> tuple[Reading, str]:
    """The state after one more token, and what may be shown now."""
    fenced, head, held, out = now.fenced, now.head, now.held, []
    if now.over:
        return now._replace(awaited=now.awaited + 1), ""
    pieces = token.split("\n")
    for k, piece in enumerate(pieces):
        line_ends = k < len(pieces) - 1
        text = held + piece
        held = ""
        if not fenced:
            at = min((p for p in map(text.find, CONTROL_TAGS) if p >= 0), default=-1)
            if at >= 0:
                return Reading(now.awaited + 1, over=True, early=now.early), "".join([*out, text[:at]])
            if not line_ends:
                held = next((part for part in _PARTS if text.endswith(part)), "")
                text = text.removesuffix(held)
        out.append(text + "\n" * line_ends)
        head = (head + piece).lstrip(" \t\r")[: len(FENCE)]
        if line_ends:
            fenced, head = fenced != (head == FENCE), ""
    return Reading(now.awaited + 1, fenced, head, held, early=now.early), "".join(out)


class _Replies(StatefulProcessor):
    """Tokens of one reply in order; those that come early wait in the state, those that come again are dropped."""

    def __init__(self, keys: list[str], ttl_ms: int) -> None:
        self.keys, self.ttl_ms = keys, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reading = handle.getValueState("reading", "awaited long, fenced boolean, head string, held string, over boolean, early int", self.ttl_ms)
        self.early = handle.getMapState("early", "seq long", "token string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        now = Reading(*self.reading.get()) if self.reading.exists() else Reading()
        before = now
        for row in rows:
            seq, token = row["seq"], row["token"]
            if seq is None or seq < now.awaited:
                continue
            if seq > now.awaited:
                if not self.early.containsKey((seq,)):
                    self.early.updateValue((seq,), (token or "",))
                    now = now._replace(early=now.early + 1)
                continue
            text = token or ""
            while text is not None:
                now, allowed = read_token(now, text)
                if allowed:
                    yield Row(**dict(zip(self.keys, key)), seq=now.awaited - 1, shown=allowed)
                text = None
                if now.early and self.early.containsKey((now.awaited,)):
                    text = self.early.getValue((now.awaited,))[0]
                    self.early.removeKey((now.awaited,))
                    now = now._replace(early=now.early - 1)
        if now != before:
            self.reading.update(tuple(now))

    def close(self) -> None:
        pass


def follow_replies(tokens: DataFrame, keys: list[str], idle_minutes: int = 60) -> DataFrame:
    """(keys, seq, shown) from a stream tokens(keys, seq, token): what each token allows to be shown, empty rows left out.

    Tokens of a reply are numbered from 0 and may come in any order and more than once; a null token is an empty one, one
    without a number is ignored. The state of a reply goes once nothing came for idle_minutes. The session needs the
    RocksDB state store (session.build sets it), and a query that should stop by itself (availableNow) needs batches without
    data switched off, which a time to live asks for again and again.
    """
    kinds = {f.name: f for f in tokens.schema.fields}
    output = StructType([kinds[k] for k in keys]).add("seq", "long").add("shown", "string")
    chosen = tokens.select(*keys, F.col("seq").cast("long"), F.col("token").cast("string"))
    return chosen.groupBy(*keys).transformWithState(_Replies(keys, idle_minutes * 60_000), output, "Append", "ProcessingTime")

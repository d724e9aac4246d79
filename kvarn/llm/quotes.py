"""Chat formatting by quotation linking.

Each message is split into lines; the number of leading ">" marks is a line's quote level, and neighbouring lines
of one level form a passage. Quoted passages, and their single lines for partial quotes, are normalised (case and
white space) and hashed, and meet the hashes of what earlier messages of the same conversation say themselves: their
whole text, paragraphs and lines. The first message that says a passage is its original. A message replies to the
original that accounts for most words of its shallowest linked level, ties to the later message. Threads follow from
the reply links by pointer doubling. conversations() orders the messages by conv_id, thread_turn and turn, so that
every message stands after the one it replies to, without its quotes and their attribution lines (a line above a quote
that opens and closes as mail programs do in English, German, French or Spanish, however long).

Originals are reduced to one row per passage before they are joined, so common lines and long conversations never
multiply. Nulls and edge cases: a null text is empty; rows with a null conv_id or turn keep their text and link to
nothing; a quote that no earlier message says is counted and removed but not linked; repeated (conv_id, turn) rows
share their links and are all kept; an empty table gives an empty result. Further columns are not read, so they may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stash, table, text_or_empty

_QUOTED = r"^\s*>"
_MARKS = r"^(\s*>)+"
#: How an attribution line opens and which verb it holds.
_ATTRIBUTION = (
    r"(?m)^(?:On [^\n]*?\bwrote|Am [^\n]*?\bschrieb|Le [^\n]*?\ba écrit|El [^\n]*?\bescribió)\b[^\n]*:[ \t]*\n(?=[ \t]*>)"
)
_QUOTE_LINES = r"(?m)^[ \t]*>[^\n]*(\n|\z)"


def own_text(text: Column) -> Column:
    """A message without quote lines and the attribution lines above them."""
    stripped = F.regexp_replace(F.regexp_replace(text, _ATTRIBUTION, ""), _QUOTE_LINES, "")
    return F.when(text.rlike(r"(?m)" + _QUOTED), F.regexp_replace(stripped, r"^\s*\n|\s+\z", "")).otherwise(text)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"\s", ""))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, says): runs of lines of one quote level, and the lines of such runs.

    Lines and runs are columns of their own, so that each message is split once and taken apart in linear time.
    """
    line = lambda x: F.struct(_level(x).alias("level"), _normal(F.regexp_replace(x, _MARKS, "")).alias("says"))
    rows = messages.select("conv_id", "turn", F.transform(F.split("text", "\n"), line).alias("lines"))
    first = F.transform("lines", lambda x, k: F.when((k == 0) | (x["level"] != F.get("lines", k - 1)["level"]), k))
    rows = rows.withColumn("starts", F.filter(first, lambda k: k.isNotNull()))
    rows = rows.withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("lines"))))
    runs = rows.select("conv_id", "turn", "lines", F.explode(F.arrays_zip("starts", "ends")).alias("run"))
    level = F.get("lines", F.col("run.starts"))["level"]
    own = F.transform(F.slice("lines", F.col("run.starts") + 1, F.col("run.ends") - F.col("run.starts")), lambda x: x["says"])
    runs = runs.select("conv_id", "turn", level.alias("level"), F.filter(own, lambda x: x != "").alias("says")).filter("level > 0")
    whole = F.filter(F.array(F.array_join("says", " ")), lambda x: x != "")
    return runs.select("conv_id", "turn", "level", F.explode(F.array_distinct(F.concat(whole, "says"))).alias("says"))


def own_passages(text: Column) -> Column:
    """Array of what a message says itself: its whole text, paragraphs and lines, normalised."""
    own = own_text(text)
    says = F.concat(F.array(own), F.split(own, r"\n\s*\n"), F.split(own, "\n"))
    return F.array_distinct(F.filter(F.transform(says, _normal), lambda s: s != ""))


def link(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_turn, thread_turn, n_quotes, n_linked, text), one row per message."""
    rows = messages.select("conv_id", "turn", "role", text_or_empty("text").alias("text"))
    quoting = rows.filter(F.col("text").rlike(r"(?m)" + _QUOTED) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    words = F.size(F.split("says", " ")).alias("words")
    quotes = quoted_passages(quoting).select("conv_id", "turn", "level", F.xxhash64("says").alias("hash"), words).distinct()
    quotes = stash(quotes, "quotes")
    plain = rows.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"))
    said = rows.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
    said = said.select("conv_id", "turn", F.explode(own_passages(F.col("text"))).alias("says"))
    originals = said.groupBy("conv_id", F.xxhash64("says").alias("hash")).agg(F.min("turn").alias("origin"))
    met = quotes.join(originals, ["conv_id", "hash"], "left")
    met = met.withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    weighed = met.groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    order = F.struct(-F.col("level"), F.col("words"), F.col("origin"))
    replies = weighed.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.when(F.col("origin").isNotNull(), order)).alias("reply_turn"),
        F.sum("n").alias("n_quotes"),
        F.coalesce(F.sum(F.when(F.col("origin").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"),
    )
    replies = stash(replies, "quote-replies")
    above = replies.filter("reply_turn is not null").select("conv_id", "turn", F.col("reply_turn").alias("up"))
    while True:  # pointer doubling: after k rounds `up` is 2 ** k replies above, or the top
        higher = above.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"))
        joined = stash(above.join(higher, ["conv_id", "up"], "left"), "quote-threads")
        above = joined.select("conv_id", "turn", F.coalesce("top", "up").alias("up"))
        if joined.filter("top is not null").isEmpty():
            break
    threads = replies.join(above, ["conv_id", "turn"], "left")
    out = plain.join(threads, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "reply_turn", F.coalesce("up", "turn").alias("thread_turn"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "text",
    )


def conversations(messages: DataFrame) -> DataFrame:
    """link() in reading order: threads of a conversation one after the other, each message after what it answers."""
    return link(messages).orderBy("conv_id", "thread_turn", "turn")


def archive(messages: DataFrame) -> DataFrame:
    """A mail archive made of plain conversations: each turn quotes the one before, every third that one's quote too."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before, older = F.lag("text", 1).over(order), F.lag("text", 2).over(order)
    mark = lambda c, by: F.concat(F.lit(by), F.regexp_replace(c, "\n", f"\n{by}"), F.lit("\n"))
    deep = F.when(F.pmod("turn", F.lit(3)) == 2, mark(older, ">> "))
    text = F.concat(F.coalesce(F.concat(F.lit("On Monday, someone wrote:\n"), F.coalesce(deep, F.lit("")), mark(before, "> ")), F.lit("")), F.col("text"))
    return messages.select("conv_id", "turn", "role", text.alias("text"))


def op6(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


def archived(spark, sf_dir: str) -> DataFrame:
    """The operator on the archive made of all conversations, which quotes at two levels."""
    return conversations(archive(table(spark, sf_dir, "conversations"))).drop("text")


_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'), ' ')"
_LINES = f"list_transform(string_split({{0}}, chr(10)), lambda x: {_NORMAL.format('x')})"
SQL = rf"""
WITH RECURSIVE m AS (
  SELECT *, lag(text, 1) OVER w AS prev, lag(text, 2) OVER w AS older FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), own AS (
  SELECT conv_id, turn, unnest(list_concat([{_NORMAL.format('text')}], list_concat({_LINES.format('text')},
    list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {_NORMAL.format('x')})))) AS says FROM m
), originals AS (
  SELECT conv_id, says, min(turn) AS origin FROM own GROUP BY ALL
), quotes AS (
  SELECT DISTINCT * FROM (
    SELECT conv_id, turn, 1 AS level, unnest(list_concat([{_NORMAL.format('prev')}], {_LINES.format('prev')})) AS says FROM m WHERE prev IS NOT NULL
    UNION ALL
    SELECT conv_id, turn, 2, unnest(list_concat([{_NORMAL.format('older')}], {_LINES.format('older')})) FROM m WHERE older IS NOT NULL AND turn % 3 = 2
  ) WHERE says <> ''
), met AS (
  SELECT q.*, len(string_split(says, ' ')) AS words, CASE WHEN o.origin < q.turn THEN o.origin END AS origin FROM quotes q LEFT JOIN originals o USING (conv_id, says)
), weighed AS (
  SELECT conv_id, turn, level, origin, count(*) AS n, sum(words)::BIGINT AS words FROM met GROUP BY ALL
), replies AS (
  SELECT conv_id, turn, sum(n)::BIGINT AS n_quotes, coalesce(sum(n) FILTER (origin IS NOT NULL), 0)::BIGINT AS n_linked,
    arg_max(origin, [-level, words, origin]) FILTER (origin IS NOT NULL) AS reply_turn FROM weighed GROUP BY ALL
), linked AS (
  SELECT m.conv_id, m.turn, m.role, r.reply_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked FROM m LEFT JOIN replies r USING (conv_id, turn)
), threads AS (
  SELECT conv_id, turn, turn AS thread_turn FROM linked WHERE reply_turn IS NULL
  UNION ALL SELECT l.conv_id, l.turn, t.thread_turn FROM linked l JOIN threads t ON l.conv_id = t.conv_id AND l.reply_turn = t.turn
)
SELECT conv_id, turn, role, reply_turn, thread_turn, n_quotes, n_linked FROM linked JOIN threads USING (conv_id, turn)
"""

"""Conversation and context windows: budgets, ring buffers, role merging, tool-result truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_context(hits: DataFrame, order: list[str], limit: int = 32_000, keys: list[str] | None = None) -> DataFrame:
    """Blocks of hits(source, source_type, text) in order while their running length stays within limit.

    The first block that overflows is replaced by a note of how many were left out.
    """
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = hits.withColumn("position", F.row_number().over(w))
    block = F.concat(F.lit("[Source "), F.col("position").cast("string"), F.lit(": "), F.coalesce("source", F.lit("?")),
                     F.lit(" ("), F.col("source_type"), F.lit(")]\n"), F.col("text"))
    sized = numbered.withColumn("block", block).withColumn("total", F.sum(F.char_length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = sized.withColumn("n_blocks", F.count("*").over(Window.partitionBy(*keys)))
    before = F.col("total") - F.char_length("block")
    shown = sized.filter(before <= limit)
    note = F.concat(F.lit("\n[... "), (F.col("n_blocks") - F.col("position") + 1).cast("string"), F.lit(" more chunks omitted due to context limit]"))
    return shown.select(*keys, "position", F.when(F.col("total") > limit, note).otherwise(F.col("block")).alias("block"), "total")


def last_turns(turns: DataFrame, n: int, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """The n latest rows of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n).drop("back")


def sanitize_history(turns: DataFrame, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """Of the last 24 items those by user and assistant, cut to 8000 characters, the last 20 of them."""
    recent = last_turns(turns, 24, key, by)
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    clean = recent.withColumn("role", role).filter(F.col("role").isin("user", "assistant"))
    return last_turns(clean.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, 8000)), 20, key, by)


def merge_roles(turns: DataFrame, key: str = "conv_id", by: str = "turn", is_plain: Column | None = None) -> DataFrame:
    """Join neighbouring messages of one role; messages with tool metadata stand alone."""
    w = Window.partitionBy(key).orderBy(by)
    plain = F.lit(True) if is_plain is None else is_plain
    flagged = turns.withColumn("plain", plain)
    same = (F.lag("role").over(w) == F.col("role")) & F.col("plain") & F.lag("plain").over(w)
    grouped = flagged.withColumn("starts", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    grouped = grouped.withColumn("run", F.sum("starts").over(w))
    parts = F.array_sort(F.collect_list(F.struct(F.col(by).alias("at"), F.coalesce("text", F.lit("")).alias("says"))))
    return grouped.groupBy(key, "run").agg(
        F.min(by).alias(by), F.first("role").alias("role"), F.array_join(F.transform(parts, lambda p: p["says"]), "\n---\n").alias("text")
    ).drop("run")


def truncate_tool_results(turns: DataFrame, context_tokens: int, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """Where a conversation fills 80 % of the context, cut all but its last three tool results to 120 characters."""
    is_tool = (F.col("role") == "user") & F.col("text").startswith("[Tool Result:")
    total = F.sum(F.char_length("text")).over(Window.partitionBy(key))
    back = F.sum(F.when(is_tool, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(F.desc(by)))
    full = total / 3.5 >= context_tokens * 0.8
    note = F.concat(F.substring("text", 1, 120), F.lit("\n... [Truncated tool result, was "), F.char_length("text").cast("string"), F.lit(" chars]"))
    rows = turns.withColumn("cut", full & is_tool & (back > 3) & (F.char_length("text") > 200))
    return rows.withColumn("text", F.when(F.col("cut"), note).otherwise(F.col("text"))).drop("cut")


def recent_text(turns: DataFrame, n: int = 2, key: str = "conv_id", by: str = "turn") -> DataFrame:
    """The last n turns of turns(query, reformulated, answer_summary) as question and answer lines."""
    line = F.concat(F.lit("Q: "), F.coalesce(F.nullif("reformulated", F.lit("")), F.col("query")),
                    F.when(F.coalesce("answer_summary", F.lit("")) != "", F.concat(F.lit("\nA: "), F.substring("answer_summary", 1, 500))).otherwise(""))
    lines = last_turns(turns, n, key, by).select(key, F.struct(F.col(by).alias("at"), line.alias("says")).alias("x"))
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda p: p["says"])
    return lines.groupBy(key).agg(F.array_join(parts, "\n").alias("context"))

"""Replies shown while they arrive: cut into tokens anywhere, they show what the whole reply shows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvarn.streaming.replies import Reading, follow_replies, read_token, shown

PARTS = ["<tool_call>", "</tool_call>", "<task_complete>", "<tool", "_call", "<", "```", "``", "`", "\n", " ", "text", "é", "```json\n", "\n```\n", "<task_complet"]


def plain(text):
    """The rule said once more, line by line."""
    out, fenced = "", False
    lines = text.split("\n")
    for k, line in enumerate(lines):
        hits = [p for p in (line.find("<tool_call"), line.find("<task_complete")) if p >= 0]
        if hits and not fenced:
            return out + line[: min(hits)]
        if k == len(lines) - 1 and not fenced:
            part = max((t[:n] for t in ("<tool_call", "<task_complete") for n in range(len(t)) if line.endswith(t[:n])), key=len)
            return out + line.removesuffix(part)
        out += line + ("\n" if k < len(lines) - 1 else "")
        fenced ^= line.lstrip(" \t\r").startswith("```")
    return out


def read_all(tokens):
    state, out = Reading(), ""
    for token in tokens:
        state, allowed = read_token(state, token)
        out += allowed
    return out


def cut(text, rng):
    at = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 6)))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.randoms())
def test_tokens_do_not_matter(text, rng):
    assert read_all([text]) == plain(text)
    assert read_all(list(text)) == plain(text)
    assert read_all(cut(text, rng)) == plain(text)


def replies(n=60):
    rng = random.Random(3)
    return {k: "".join(rng.choices(PARTS, k=rng.randint(0, 12))) for k in range(n)}


def test_whole_replies(spark):
    texts = replies(300)
    rows = spark.createDataFrame([*texts.items(), (-1, None), (-2, "")], "id long, text string")
    got = {r.id: r.shown for r in rows.select("id", shown(F.col("text")).alias("shown")).collect()}
    assert got == {**{k: plain(t) for k, t in texts.items()}, -1: None, -2: ""}


@pytest.fixture
def state_settings(spark):
    """The state store that such streams need, and no batches without data: with a time to live they would never end."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_a_stream_shows_what_whole_replies_show(spark, tmp_path, state_settings):
    """Tokens in any order over several batches, repeated, after a restart in between."""
    rng, texts = random.Random(5), replies()
    rows = [(k, s, token) for k, t in texts.items() for s, token in enumerate(cut(t, rng))]
    rows += rng.sample(rows, 20) + [(0, None, "lost"), (10**6, 0, None)]
    rng.shuffle(rows)
    schema = "conv long, seq long, token string"
    given_, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given_)
        query = follow_replies(stream, ["conv"]).writeStream.format("parquet").option("checkpointLocation", mark)
        query.trigger(availableNow=True).start(out).awaitTermination(60)

    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(given_)
        run()
    found = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.conv, r.seq)):
        found[r.conv] = found.get(r.conv, "") + r.shown
    assert found == {k: plain(t) for k, t in texts.items() if plain(t)}

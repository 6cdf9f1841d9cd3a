"""Writers of native formats, verbs, and the queries on them against their SQL (test_core.py runs those of the catalogue)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from sessionloom.operators import incremental, trim, verbs
from sessionloom.plans import canonical as c
from sessionloom.plans import expressions, formats  # noqa: F401
from sessionloom.sources import base, native
from sessionloom.sources.base import Sessions


@pytest.fixture(scope="module")
def mixed(spark):
    """Messages with several blocks, thinking, an error, JSON results and a result without a call."""
    rows = [
        ("u", 0, 0, "user", "text", "ask \"it\"\nnow", None, None, None, None, None, False),
        ("u", 1, 0, "assistant", "thinking", "hm", None, None, None, None, None, False),
        ("u", 1, 1, "assistant", "text", "I look", None, None, None, None, None, False),
        ("u", 1, 2, "assistant", "tool_use", None, "t1", "Bash", '{"command":"ls"}', None, None, False),
        ("u", 2, 0, "user", "tool_result", None, "t1", None, None, "a\nb", None, True),
        ("u", 3, 0, "assistant", "text", "done", None, None, None, None, None, False),
        ("v", 0, 0, "user", "text", "other", None, None, None, None, None, False),
    ]
    schema = "id string, msg_idx int, block_idx int, role string, type string, text string, tool_id string, tool_name string, tool_input_json string, result_text string, result_json string, is_error boolean"
    b = spark.createDataFrame(rows, schema).withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp")).withColumn("doc", F.concat(F.lit("simple:"), "id"))
    blocks = c.blocks(b, **{k: F.col(k) for k in c.BLOCK_TYPES})
    s = b.select("id", "doc", "ts").distinct()
    sessions = c.sessions(s, harness=F.lit("simple"), id=F.col("id"), source=F.lit(None), ts=F.col("ts"), title=F.lit("T"), cwd=F.lit("/w"), model=F.lit("m"), seq=F.xxhash64("id"))
    return Sessions(sessions, blocks)


@pytest.mark.parametrize("harness", ["pi", "codex", "amp", "cowork_remote", "claude_chat", "freebuff", "hermes", "cursor", "opencode"])
def test_what_is_written_is_read_again(mixed, harness):
    got = base.ADAPTERS[harness](**native.native_tables(mixed, harness))
    key = lambda r: (r.doc.split(":")[1], r.type, r.text or r.result_text, r.tool_id, r.tool_name, r.tool_input_json, r.role, r.is_error and harness != "hermes")
    assert sorted(map(str, map(key, got.blocks.collect()))) == sorted(map(str, map(key, mixed.blocks.collect())))
    order = [r.text or r.result_text for r in got.blocks.where("doc like '%:u'").orderBy("msg_idx", "block_idx").collect() if r.type != "tool_use"]
    assert order == ["ask \"it\"\nnow", "hm", "I look", "a\nb", "done"]
    assert {r.id for r in got.sessions.collect()} == {"u", "v"}


def test_unknown_targets_and_saved_files(spark, mixed, tmp_path):
    with pytest.raises(ValueError):
        native.native_tables(mixed, "nothing")
    native.save(mixed, "pi", f"file://{tmp_path}/pi")
    back = base.ADAPTERS["pi"](base.read_lines(spark, f"file://{tmp_path}/pi/lines", "*.txt"))
    assert back.blocks.where("type = 'text'").count() == 4
    with pytest.raises(ValueError):
        base.discover({}, ["pi"])


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 2), (3, None, 0)], "k int, v string, n int")
    assert sorted(map(tuple, incremental.upsert(old, new, ["k"], "n").collect()), key=str) == [(1, "a", 0), (2, "c", 2), (3, None, 0)]
    assert incremental.upsert(old, new, ["k"]).where("k = 2").first().v == "z"


def test_handoff_trims_and_converts(mixed):
    kept = verbs.handoff(mixed, "freebuff", budget=3)["messages"]
    assert 0 < kept.count() <= 5
    assert set(verbs.handoff(mixed, "claude_code")) == {"text"}
    assert trim.decide(mixed.blocks).count() == 5

"""Views, masks, arguments, patches."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from sessionloom.functions import arguments, patch
from sessionloom.operators import display
from tests.test_core import blocks


def test_ranges_and_dates():
    assert arguments.parse_ref("a#b#3-5") == ("a#b", (2, 5)) and arguments.parse_ref("a#3") == ("a", (2, 3)) and arguments.parse_ref("a#3-") == ("a", (2, None)) and arguments.parse_ref("a#-2") == ("a", (0, 2)) and arguments.parse_ref("a") == ("a", None)
    for bad in ("a#0", "a#5-3", "a#x", "a#", "a#-"):
        with pytest.raises(ValueError):
            arguments.parse_ref(bad)
    assert arguments.bounded((2, None), 4) == (2, 4)
    with pytest.raises(ValueError):
        arguments.bounded((2, 5), 4)
    assert arguments.parse_date("2024-01-02", True).isoformat() == "2024-01-02T23:59:59+00:00" and arguments.parse_date("2024-01-02T01:00:00+01:00").hour == 0


def test_ages(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 31),)], "n timestamp")
    for ts, want in ((datetime(2024, 1, 30, 23, 59, 30), "now"), (datetime(2024, 1, 30, 23), "1h"), (datetime(2024, 1, 29), "2d"), (datetime(2024, 1, 1), "4w"), (datetime(2023, 11, 1), "3mo"), (datetime(2022, 1, 1), "2y"), (datetime(2025, 1, 1), "now")):
        assert df.select(arguments.relative_age(F.lit(ts), F.col("n"))).first()[0] == want


def test_patches(spark):
    edit = "*** Begin Patch\n*** Update File: a.py\n@@\n x\n-old\n+new\n*** End Patch"
    assert patch.read_patch(edit) == ("Edit", {"file_path": "a.py", "old_string": "x\nold", "new_string": "x\nnew"})
    assert patch.read_patch("*** Begin Patch\n*** Add File: b\n+1\n+2\n*** End Patch") == ("Write", {"file_path": "b", "content": "1\n2\n"})
    for raw in ("", "x", edit.replace("@@", "@@\n a\n-b\n+c\n@@"), edit.replace("Update", "Delete"), "*** Begin Patch\n*** Update File: a\n x\n*** End Patch"):
        assert patch.read_patch(raw) is None
    got = spark.createDataFrame([(edit,), ("no",), (None,)], "t string").select(patch.patch_tool("t").alias("p")).select("p.*").collect()
    assert got[0].tool == "Edit" and json.loads(got[0].input)["new_string"] == "x\nnew" and got[1].tool is None and got[2].input is None


def test_view_and_mask(spark):
    b = blocks(spark, [(0, "user", "text", "password=abc", None, False), (1, "assistant", "thinking", "api_key=abc", None, False), (1, "assistant", "tool_use", '{"command":"x --token=abc\\" y","n":{"k":"sk-' + "a" * 20 + '"},"api_key":"left"}', "t", False), (2, "user", "tool_result", "ok", "t", False)])
    assert {r.type for r in display.view(b, tools=False, reasoning=False).collect()} == {"text"} and display.view(b, user=False, assistant=False).count() == 3
    got = {r.type: r for r in display.masked(b).collect()}
    assert got["text"].text == "password=********" and got["thinking"].text == "api_key=********"
    shown = json.loads(got["tool_use"].tool_input_json)
    assert shown["n"]["k"] == "********" and "abc" not in shown["command"] and got["tool_result"].result_text == "ok"


def test_examples_and_fallback(spark):
    items = spark.createDataFrame([("d", i, 0.9, 0.5, 0.0, 100 + i, "keep") for i in range(5)], "doc string, msg_idx int, importance float, future_utility float, redundancy float, token_cost long, decision string")
    assert [r.msg_idx for r in display.examples(items).orderBy("msg_idx").collect()] == [2, 3, 4]
    b = blocks(spark, [(i, "user", "text", "x", None, False) for i in range(5)])
    assert {r.decision for r in display.allocate_or_keep(items, b, 10, items).collect()} == {"keep"}
    assert display.decision_counts(items).first().asDict() == {"doc": "d", "keep": 5, "compress": 0, "drop": 0}
    assert [r[0] for r in spark.createDataFrame([(300, 100), (0, 0)], "a int, b int").select(display.savings_percent(F.col("a"), F.col("b"))).collect()] == [66, None]
    state = display.prompt_state(spark.createDataFrame([(1, "b\n```"), (0, "a")], "rank int, content string"), "q").first()[0]
    assert state == "Query: q\n[1] a\n[2] b '''"


def test_parent_files(spark):
    s = spark.createDataFrame([("/p/x.jsonl", "header")], "file string, id string")
    p = spark.createDataFrame([("a", "/p/x.jsonl"), ("b", "/p/gone.jsonl"), ("c", "/p/odd.txt")], "doc string, parent_file string")
    assert {r.doc: r.parent for r in display.parent_lineage(s, p).collect()} == {"a": "header", "b": "gone"}

"""Interleaved logs and key-value stores."""

from __future__ import annotations

import json

from sessionloom.sources import logs
from tests.test_sources import lines, rows


def item(kind, **payload):
    return {"timestamp": "2024-01-01T00:00:00Z", "type": kind, "payload": payload}


def test_codex_mirrored_results_and_searches(spark):
    records = [
        item("session_meta", id="c1", cwd="/w", git={"branch": "b"}),
        item("turn_context", turn_id="t", model="m"),
        item("response_item", type="message", role="user", content=[{"type": "input_text", "text": " <environment_context> x"}]),
        item("response_item", type="message", role="user", content=[{"type": "input_text", "text": "q"}]),
        item("response_item", type="reasoning", summary=[{"type": "summary_text", "text": "a"}, {"type": "summary_text", "text": "b"}]),
        item("response_item", type="function_call", name="shell", call_id="k", arguments=json.dumps({"command": ["bash", "-lc", "ls"]})),
        item("event_msg", type="exec_command_end", call_id="k", aggregated_output="out", exit_code=1),
        item("response_item", type="function_call_output", call_id="k", output="mirror"),
        item("response_item", type="function_call", name="view", call_id="k", arguments="{}"),
        item("response_item", type="function_call_output", call_id="k", output="second"),
        item("response_item", type="web_search_call", action={"type": "search", "query": "z"}),
        item("event_msg", type="web_search_end", call_id="ws", query="z", action={"query": "z", "type": "search"}),
        item("response_item", type="custom_tool_call", name="apply_patch", call_id="p", input="*** Begin"),
        item("response_item", type="custom_tool_call_output", call_id="p", output=json.dumps({"output": "done", "metadata": {"exit_code": 0}})),
    ]
    found = logs.codex(lines(spark, records))
    s = found.sessions.first()
    assert (s.id, s.cwd, s.branch, s.model) == ("c1", "/w", "b", "m")
    got = [(g[3], g[4], g[5], g[6], g[7], g[8], g[10]) for g in rows(found)]
    assert got == [
        ("text", "q", None, None, None, None, False),
        ("thinking", "a\n\nb", None, None, None, None, False),
        ("tool_use", None, "k", "Bash", '{"command":"ls"}', None, False),
        ("tool_result", None, "k", None, None, "out", True),
        ("tool_use", None, "k", "view", "{}", None, False),
        ("tool_result", None, "k", None, None, "second", False),
        ("tool_use", None, "ws", "WebSearch", '{"query":"z","type":"search"}', None, False),
        ("tool_result", None, "ws", None, None, "z", False),
        ("tool_use", None, "p", "apply_patch", '{"input":"*** Begin"}', None, False),
        ("tool_result", None, "p", None, None, "done", False),
    ]


def test_codex_searches_pair_with_the_latest_open_one(spark):
    call = lambda q: item("response_item", type="web_search_call", action={"query": q})
    end = lambda q, i: item("event_msg", type="web_search_end", call_id=i, query=q, action={"query": q})
    records = [item("session_meta", id="c2"), call("a"), call("a"), end("a", "x"), end("a", "y"), end("b", "u"), end("b", "v"), call("b"), call("b"), call("b")]
    got = [(g[3], g[5]) for g in rows(logs.codex(lines(spark, records)))]
    uses = [i for kind, i in got if kind == "tool_use"]
    assert uses[:4] == ["y", "x", "v", "u"] and uses[4].startswith("web_search:")


def test_cursor(spark):
    s = spark.createDataFrame([("c", "t", "/w", "m", 1704067200000)], "id string, title string, cwd string, model string, created_at long")
    data = ["\x0a\x05binary", {"role": "user", "content": "<user_info>x"}, {"role": "user", "content": "<user_query>\nq\n</user_query>"}, {"role": "assistant", "content": [{"type": "reasoning", "text": "r"}, {"type": "text", "text": "a [REDACTED]"}, {"type": "tool-call", "toolCallId": "k", "toolName": "Shell", "args": {"b": 1, "a": 2}}]}, {"role": "tool", "content": [{"type": "tool-result", "toolCallId": "k", "result": "out"}]}]
    blobs = spark.createDataFrame([("c", i, bytearray((d if isinstance(d, str) else json.dumps(d)).encode())) for i, d in enumerate(data)], "session_id string, rowid long, data binary")
    assert [(g[0], g[3], g[4], g[5], g[7]) for g in rows(logs.cursor(s, blobs))] == [(0, "text", "q", None, None), (1, "thinking", "r", None, None), (1, "text", "a ", None, None), (1, "tool_use", None, "k", '{"a":2,"b":1}'), (2, "tool_result", None, "k", None)]


def test_cursor_desktop_order_and_bubbles(spark):
    headers = spark.createDataFrame([("s", "n", 1704067200000)], "id string, name string, created_at long")
    bubble = lambda b, **d: (f"bubbleId:s:{b}", json.dumps({"bubbleId": b, **d}))
    kv = spark.createDataFrame([
        ("composerData:s", json.dumps({"fullConversationHeadersOnly": [{"bubbleId": x} for x in ("u", "a2", "a1", "gone", "a3", "u")]})),
        bubble("a1", type=2, text="one", toolFormerData={"name": "read", "toolCallId": "x\ny", "params": '{"p": 1}', "status": "error", "result": "bad"}),
        bubble("a2", type=2, thinking={"text": "hm"}), bubble("a3", type=2, text="end"), bubble("u", type=1, text="q"), bubble("other", type=1, text="no"), ("bubbleId:s:z", "broken"),
    ], "key string, value string")
    assert [(g[0], g[2], g[3], g[5]) for g in rows(logs.cursor_desktop(headers, kv))] == [(0, "user", "text", None), (1, "assistant", "thinking", None), (1, "assistant", "text", None), (1, "assistant", "tool_use", "x_y"), (2, "user", "tool_result", "x_y"), (3, "assistant", "text", None)]


def test_grok_bot_queues_by_name(spark):
    call = lambda i, n: {"type": "tool_use", "id": i, "name": n, "input": {}}
    result = lambda n, r: {"type": "tool_result", "name": n, "result": r}
    records = [{"role": "user", "message": {"content": [{"type": "text", "text": "q"}]}}, {"role": "assistant", "message": {"content": [call("1", "a"), call("2", "b"), call("3", "a")]}}, {"role": "tool", "message": {"content": [result("b", "B"), result("a", {"failure": 1}), result("c", "C"), result("d", "D")]}}]
    got = [(g[5], g[8], g[9], g[10]) for g in rows(logs.grok_bot(lines(spark, records))) if g[3] == "tool_result"]
    assert got == [("2", "B", None, False), ("1", None, '{"failure":1}', True), ("3", "C", None, False), ("orphan:d", "D", None, False)]

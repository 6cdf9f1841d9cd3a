"""Step logs."""

from __future__ import annotations

import json

from sessionloom.sources import base, steps
from tests.test_sources import documents, lines, rows


def test_grok_times_by_ordinal(spark):
    chat = lines(spark, [{"type": "user", "content": "<user_info>"}, {"type": "user", "content": [{"type": "text", "text": "q"}]}, {"type": "reasoning", "summary": [{"text": "hm"}]}, {"type": "assistant", "content": "", "tool_calls": [{"id": "c", "name": "read", "arguments": '{"p":1}'}]}, {"type": "tool_result", "tool_call_id": "c", "content": "r"}, {"type": "assistant", "content": "done"}], "/s/g.jsonl")
    up = lambda ms, **u: {"params": {"_meta": {"agentTimestampMs": ms}, "update": u}}
    updates = lines(spark, [up(1000, sessionUpdate="user_message_chunk"), up(2000, sessionUpdate="agent_thought_chunk"), up(3000, sessionUpdate="tool_call", toolCallId="c"), up(4000, sessionUpdate="tool_call_update", toolCallId="c", status="failed"), up(5000, sessionUpdate="agent_message_chunk")], "/s/g.jsonl")
    found = steps.grok(chat, updates)
    assert [(g[2], g[3], g[10]) for g in rows(found)] == [("user", "text", False), ("assistant", "thinking", False), ("assistant", "tool_use", False), ("user", "tool_result", True), ("assistant", "text", False)]
    assert [r.ts.second for r in found.blocks.orderBy("msg_idx").collect()] == [1, 2, 3, 4, 5]


def test_fx_turns(spark):
    turn = {"user": {"text": "q"}, "execution": {"tool_steps": [{"assistant": "a", "tool_calls": [{"id": "c", "name": "n", "arguments_json": '{"x":1}'}], "tool_results": [{"tool_call_id": "c", "output": {"k": 1}, "status": "failure"}]}]}, "assistant": "end"}
    cut = {"kind": "interrupted", "user": {"text": "p"}, "assistant": "part", "tool_call": {"id": "d", "name": "n"}}
    event = lambda t: {"kind": "history_turn_committed", "timestamp_ms": 1000, "payload": {"turn": t}}
    got = rows(steps.fx(documents(spark, {"session": {"id": "f"}, "events": [event(turn), {"kind": "other"}, event(cut)]})))
    assert [(g[0], g[2], g[3]) for g in got] == [(0, "user", "text"), (1, "assistant", "text"), (1, "assistant", "tool_use"), (2, "user", "tool_result"), (3, "assistant", "text"), (4, "user", "text"), (5, "assistant", "text"), (5, "assistant", "tool_use")]
    assert got[3][9] == '{"k":1}' and got[3][10]


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, int):
        return number(n << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(n << 3 | 2) + number(len(value)) + value


def test_protobuf_steps(spark):
    meta = field(5, field(1, field(1, 1704067200) + field(2, 500_000_000)) + field(4, field(1, "c")))
    plan = field(20, field(3, "hm") + field(1, "a") + field(7, field(1, "c") + field(2, "run") + field(3, '{"b":1,"a":2}')))
    table = [(1, 14, 3, meta + field(19, field(2, "q")), b""), (2, 15, 3, meta + plan, b""), (3, 21, 7, meta + field(28, field(1, "out")), field(9, "bad")), (4, 21, 2, meta, b""), (5, 98, 3, b"\xff", b""), (6, 14, 3, b"\x9a", b"")]
    s = spark.createDataFrame([("s", "t", "/w", 0)], "id string, title string, cwd string, created_at long")
    frame = spark.createDataFrame([("s", i, k, st, bytearray(p), bytearray(e)) for i, k, st, p, e in table], "session_id string, idx int, step_type int, status int, step_payload binary, error_details binary")
    got = rows(steps.antigravity(s, frame))
    assert [(g[0], g[3]) for g in got] == [(0, "text"), (1, "thinking"), (1, "text"), (1, "tool_use"), (2, "tool_result")]
    assert got[3][7] == '{"a":2,"b":1}' and got[4][8] == "bad" and got[4][10]
    assert list(steps.fields(b"\x08\x96\x01\x12\x03ab")) == [(1, 150)]


def test_all_harnesses_have_an_adapter():
    from sessionloom.functions.json import ALIASES
    from sessionloom.sources import logs, transcripts, trees  # noqa: F401

    assert set(base.ADAPTERS) == set(ALIASES)
    assert json.dumps(sorted(base.ADAPTERS)).count('"') == 38

"""Adapters against small native documents."""

from __future__ import annotations

import json

import pytest
from sessionloom.functions import json as J
from sessionloom.sources import base, render, transcripts, trees


def lines(spark, records, file="/s/abc.jsonl"):
    rows = [(file, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    return base.parsed(spark.createDataFrame(rows, "file string, line_no int, line string"))


def documents(spark, *docs):
    rows = [(f"/s/d{i}.json", 0, json.dumps(d)) for i, d in enumerate(docs)]
    return base.parsed(spark.createDataFrame(rows, "file string, line_no int, line string")).drop("line_no")


def rows(found):
    keys = "msg_idx block_idx role type text tool_id tool_name tool_input_json result_text result_json is_error".split()
    got = sorted((r.asDict() for r in found.blocks.collect()), key=lambda r: (r["doc"], r["msg_idx"], r["block_idx"]))
    return [tuple(r[k] for k in keys) for r in got]


def test_simple_pairs_results_without_ids(spark):
    doc = {"id": "s1", "timestamp": "2024-01-01T00:00:00Z", "title": "T", "messages": [
        {"role": "User ", "content": "hello"},
        {"role": "system", "content": "no"},
        {"role": "assistant", "content": [{"type": "tool_use", "name": "Bash", "input": {"command": "a"}}, {"type": "tool_use", "id": "own", "name": "Bash", "input": {"command": "b"}}, {"type": "tool_use", "name": "Read", "input": {"file_path": "c"}}]},
        {"role": "user", "content": [{"type": "tool_result", "content": "A"}, {"type": "tool_result", "tool_use_id": "own", "content": {"x": 1}}, {"type": "tool_result", "is_error": True}, {"type": "odd"}]}]}
    found = transcripts.simple(documents(spark, doc, {"no": "messages"}))
    assert [r.id for r in found.sessions.collect()] == ["s1"]
    got = rows(found)
    assert [(g[0], g[2], g[3]) for g in got] == [(0, "user", "text"), (1, "assistant", "tool_use"), (1, "assistant", "tool_use"), (1, "assistant", "tool_use"), (2, "user", "tool_result"), (2, "user", "tool_result"), (2, "user", "tool_result")]
    made = [g[5] for g in got[1:]]
    assert made[0] == made[3] and made[1] == made[4] == "own" and made[2] == made[5] and made[0] != made[2]
    assert got[4][8] == "A" and got[5][9] == '{"x":1}' and got[6][8] == "" and got[6][10]


def test_claude_code_metadata_and_blocks(spark):
    records = [
        "not json", "",
        {"type": "summary", "summary": "S"},
        {"type": "user", "sessionId": "u1", "cwd": "/w", "gitBranch": "main", "version": "1", "timestamp": "2024-01-02T00:00:00Z", "message": {"content": "hi"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"model": "m", "content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "x"}, {"type": "tool_use", "id": "c", "name": "Read", "input": {"file_path": "f"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "text", "text": "r"}], "is_error": True}, {"type": "tool_result"}]}},
        {"type": "custom-title", "customTitle": "C1"}, {"type": "custom-title", "customTitle": "C2"},
    ]
    found = transcripts.claude_code(lines(spark, records))
    s = found.sessions.first()
    assert (s.id, s.cwd, s.branch, s.cli_version, s.model, s.title, str(s.ts)) == ("u1", "/w", "main", "1", "m", "C2", "2024-01-01 00:00:00")
    assert [(g[0], g[1], g[3]) for g in rows(found)] == [(0, 0, "text"), (1, 0, "thinking"), (1, 1, "text"), (1, 2, "tool_use"), (2, 0, "tool_result")]
    assert rows(found)[-1][9] == '[{"text":"r","type":"text"}]' and rows(found)[-1][10]


def test_pi_shell_runs_and_results(spark):
    records = [
        {"type": "session", "id": "p1", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "message", "message": {"role": "user", "content": "q"}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "id": "t", "name": "bash", "arguments": {"command": "ls"}}]}},
        {"type": "message", "message": {"role": "toolResult", "toolCallId": "t", "content": [{"type": "text", "text": "out"}], "isError": False}},
        {"type": "message", "message": {"role": "bashExecution", "command": "pwd", "output": "/w", "exitCode": 1}},
        {"type": "model_change", "modelId": "a"}, {"type": "model_change", "modelId": "b"}, {"type": "session_info", "name": " N "},
    ]
    found = transcripts.campfire(lines(spark, records))
    s = found.sessions.first()
    assert (s.harness, s.id, s.model, s.title) == ("campfire", "p1", "b", "N")
    got = rows(found)
    assert [(g[0], g[3], g[5]) for g in got] == [(0, "text", None), (1, "tool_use", "t"), (2, "tool_result", "t"), (3, "tool_use", "bash_exec_1"), (4, "tool_result", "bash_exec_1")]
    assert got[2][8] == "out" and got[4][10]


def test_amp_and_cowork_remote(spark):
    doc = {"id": "a", "created": 1704067200000, "title": "t", "messages": [
        {"role": "user", "content": [{"type": "text", "text": "q"}], "meta": {"sentAt": 1704067260000}},
        {"role": "assistant", "content": [{"type": "tool_use", "id": "x", "name": "Bash", "input": {"cmd": "ls"}}, {"type": "text", "text": " "}]},
        {"role": "user", "content": [{"type": "tool_result", "toolUseID": "x", "run": {"status": "cancelled", "reason": "why"}}]},
        {"role": "info", "content": "no"}]}
    got = rows(transcripts.amp(documents(spark, doc)))
    assert [(g[0], g[3]) for g in got] == [(0, "text"), (1, "tool_use"), (2, "tool_result")] and got[2][8] == "why" and got[2][10]
    event = {"event_id": "1", "type": "user", "message": {"content": "a"}}
    remote = documents(spark, {"id": "r", "events": [event, event, {"event_id": "2", "type": "assistant", "message": {"content": "b"}}, {"event_id": "3", "type": "assistant", "parent_tool_use_id": "p", "message": {"content": "sub"}}]})
    assert [g[4] for g in rows(transcripts.cowork_remote(remote))] == ["a", "b"]
    assert transcripts.conflicting_events(remote).count() == 0


def test_opencode_splits_at_tools(spark):
    session = spark.createDataFrame([("s", "/d", "t", "1", 1704067200000, None), ("gone", "/d", "t", "1", 0, 5)], "id string, directory string, title string, version string, time_created long, time_archived long")
    message = spark.createDataFrame([("m1", "s", 1, '{"role":"user"}'), ("m2", "s", 2, '{"role":"assistant"}'), ("m3", "s", 3, "broken")], "id string, session_id string, time_created long, data string")
    parts = [("p1", "m1", {"type": "text", "text": "q"}), ("p2", "m1", {"type": "text", "text": "no", "synthetic": True}), ("p3", "m2", {"type": "text", "text": "a"}), ("p4", "m2", {"type": "reasoning", "text": "b"}), ("p5", "m2", {"type": "tool", "tool": "read", "callID": "c", "state": {"status": "completed", "input": {"filePath": "f"}, "output": "o"}}), ("p6", "m2", {"type": "text", "text": "z"})]
    part = spark.createDataFrame([(a, b, json.dumps(d)) for a, b, d in parts], "id string, message_id string, data string")
    got = rows(transcripts.opencode(session, message, part))
    assert [(g[0], g[1], g[3]) for g in got] == [(0, 0, "text"), (1, 0, "text"), (1, 1, "thinking"), (2, 0, "tool_use"), (3, 0, "tool_result"), (4, 0, "text")]
    assert got[3][6:8] == ("Read", '{"file_path":"f"}')


def test_hermes_and_freebuff(spark):
    s = spark.createDataFrame([("h", "t", "m", 1704067200.5, 0)], "id string, title string, model string, started_at double, archived int")
    m = spark.createDataFrame([(1, "h", "user", "q", None, None, None, 1.0, 1), (2, "h", "assistant", "", None, '[{"id":"c","function":{"name":"terminal","arguments":"{\\"command\\":\\"ls\\"}"}}]', "why", 2.0, 1), (3, "h", "tool", '{"b":1,"a":2}', "c", None, None, 3.0, 1), (4, "h", "user", "no", None, None, None, 4.0, 0)], "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, reasoning string, timestamp double, active int")
    got = rows(transcripts.hermes(s, m))
    assert [(g[0], g[3]) for g in got] == [(0, "text"), (1, "thinking"), (1, "tool_use"), (2, "tool_result")] and got[2][6] == "Bash" and got[3][9] == '{"a":2,"b":1}'
    t = spark.createDataFrame([("f", "t", "/w", 1)], "id string, title string, cwd string, created_at long")
    fm = spark.createDataFrame([("f", 2, "assistant", '[{"type":"text","text":"b"}]', 1), ("f", 1, "user", '"a"', 1)], "thread_id string, seq int, role string, parts string, created_at long")
    assert [g[4] for g in rows(transcripts.freebuff(t, fm))] == ["a", "b"]


def node(i, parent, role="user", text=None, **more):
    return {"id": i, "parent": parent, "message": {"id": i, "author": {"role": role}, "create_time": float(ord(i)), "content": {"content_type": "text", "parts": [text or i]}, **more}}


def test_trees_follow_the_leaf_or_fall_back(spark):
    good = {"id": "g", "current_node": "c", "mapping": {"a": node("a", None), "b": node("b", "a", "assistant"), "x": node("x", "a"), "c": node("c", "b")}}
    cycle = {"id": "k", "current_node": "a", "mapping": {"b": node("b", "a"), "a": node("a", "b")}}
    missing = {"id": "m", "current_node": "b", "mapping": {"b": node("b", "zz"), "a": node("a", None)}}
    found = trees.chatgpt(documents(spark, good, cycle, missing))
    texts = {}
    for r in sorted(found.blocks.collect(), key=lambda r: r.msg_idx):
        texts.setdefault(r.doc[-1], []).append(r.text)
    assert texts == {"g": ["a", "b", "c"], "k": ["a", "b"], "m": ["a", "b"]}
    chat = {"uuid": "u", "current_leaf_message_uuid": "2", "chat_messages": [{"uuid": "1", "sender": "human", "text": "q"}, {"uuid": "9", "sender": "human", "text": "other", "parent_message_uuid": "1"}, {"uuid": "2", "sender": "assistant", "parent_message_uuid": "1", "text": "a", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "n", "input": {}}, {"type": "tool_result", "tool_use_id": "t", "content": "r"}]}]}
    assert [(g[0], g[2], g[3]) for g in rows(trees.claude_chat(documents(spark, chat)))] == [(0, "user", "text"), (1, "assistant", "text"), (1, "assistant", "tool_use"), (2, "user", "tool_result")]


def test_chatgpt_calls_and_results(spark):
    doc = {"id": "g", "current_node": "c", "mapping": {"a": node("a", None), "b": node("b", "a", "assistant", '{"q": 1}', recipient="search"), "c": node("c", "b", "tool", "found")}}
    got = rows(trees.chatgpt(documents(spark, doc)))
    assert [(g[3], g[5], g[6]) for g in got] == [("text", None, None), ("tool_use", "b", "search"), ("tool_result", "b", None)] and got[1][7] == '{"q":1}'


def test_round_trips(spark):
    doc = {"id": "s1", "timestamp": "2024-01-01T00:00:00.000Z", "cwd": "/w \"x\"", "messages": [
        {"role": "user", "content": "hello\n\"you\"", "timestamp": "2024-01-01T00:00:01.000Z"},
        {"role": "assistant", "content": [{"type": "thinking", "text": "t"}, {"type": "tool_use", "id": "i", "name": "Bash", "input": {"command": "a"}}], "timestamp": "2024-01-01T00:00:02.000Z"},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "i", "content": {"k": [1]}, "is_error": True}], "timestamp": "2024-01-01T00:00:03.000Z"}]}
    first = transcripts.simple(documents(spark, doc))
    assert json.loads(render.convert(first, "simple").first().text) == doc
    native = [json.loads(x) for x in render.convert(first, "claude_code").first().text.split("\n")]
    assert native[1]["parentUuid"] == native[0]["uuid"] and native[0]["parentUuid"] is None
    assert rows(transcripts.claude_code(lines(spark, native))) == rows(first)
    with pytest.raises(ValueError):
        render.convert(first, "nothing")


def test_typed_or_raw_and_aliases(spark):
    df = spark.createDataFrame([("Read", '{"file_path":"f"}'), ("Read", '{"file_path":"f","more":1}'), ("Read", '{"offset":1}'), ("Edit", '{"file_path":"f","old_string":"a","new_string":"b","replace_all":true}'), ("Bash", '{"command":1}'), ("Other", "{}")], "n string, i string")
    assert [r[0] for r in df.select(J.typed(df.n, df.i)).collect()] == [True, False, False, True, False, False]
    assert J.harness("claude-code") == "claude_code" and J.harness("agy") == "antigravity"
    with pytest.raises(ValueError):
        J.harness("nobody")


def test_teammates(spark):
    s = spark.createDataFrame([("d1", "aaaaaaaa-1", None), ("d2", "bbbbbbbb-1", "AAAAAAAA"), ("d3", "cccccccc-1", "dddddddd"), ("d4", "dddddddd-1", None), ("d5", "dddddddd-2", None)], "doc string, id string, team_prefix string")
    assert [tuple(r) for r in base.teammate_lineage(s).collect()] == [("d2", "aaaaaaaa-1")]

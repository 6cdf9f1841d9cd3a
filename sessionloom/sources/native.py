"""Sinks: canonical sessions as the native rows of more formats: JSON lines, documents, and the tables that adapters read.

Each writer takes Sessions and returns the tables, by name, that the adapter of that format takes.  A tool result is a record
of its own where the format has it so; the blocks of a message before it and after it stay together.  Usage, stop reasons and
attached files aren't canonical and aren't written.  An empty table of sessions gives tables without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Sessions, parsed
from .transcripts import TOOL_KEYS, TOOL_NAMES

_V = F.col
_TS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
Tables = dict[str, DataFrame]


def _time(ts: str) -> Column:
    return F.date_format(ts, _TS)


def _millis(ts: str) -> Column:
    return F.unix_millis(ts)


def _input() -> Column:
    return F.parse_json(F.coalesce("tool_input_json", F.lit("{}")))


def _result() -> Column:
    """A result as it is, a text or other JSON, as a VARIANT."""
    text = F.parse_json(F.regexp_replace(F.to_json(F.array(F.coalesce("result_text", F.lit("")))), r"(?s)^\[(.*)\]$", "$1"))
    return F.when(F.col("result_text").isNull() & F.col("result_json").isNotNull(), F.parse_json("result_json")).otherwise(text)


def _native_tool(harness: str) -> tuple[Column, Column]:
    """A call's native name and input, where the format has names of its own."""
    name, given = F.col("tool_name"), F.coalesce("tool_input_json", F.lit("{}"))
    out_name, out_input = name, given
    for native, canonical in TOOL_NAMES.get(harness, {}).items():
        back = {v: k for k, v in TOOL_KEYS.get((harness, native), {}).items()}
        renamed = given
        if back:
            table = F.create_map(*[F.lit(x) for kv in back.items() for x in kv])
            renamed = F.to_json(F.transform_keys(F.from_json(given, "map<string,variant>"), lambda k, _: F.coalesce(table[k], k)))  # noqa: B023
        out_input = F.when(name == canonical, renamed).otherwise(out_input)
        out_name = F.when(name == canonical, native).otherwise(out_name)
    return out_name, out_input


def _is(kind: str) -> Column:
    return F.col("type") == kind


def _block(call: str = "tool_use", given: str = "input", result: str = "tool_result", result_id: str = "tool_use_id") -> Column:
    """A block as a struct of JSON, in the widespread form; null fields are left out when it is written."""
    return F.struct(
        F.when(_is("tool_use"), call).when(_is("tool_result"), result).otherwise(F.col("type")).alias("type"),
        F.when(_is("text"), F.col("text")).alias("text"),
        F.when(_is("thinking"), F.col("text")).alias("thinking"),
        F.when(_is("tool_use"), F.col("tool_id")).alias("id"),
        F.when(_is("tool_use"), F.col("tool_name")).alias("name"),
        F.when(_is("tool_use"), _input()).alias(given),
        F.when(_is("tool_result"), F.col("tool_id")).alias(result_id),
        F.when(_is("tool_result"), _result()).alias("content"),
        F.when(_is("tool_result") & F.col("is_error"), F.lit(True)).alias("is_error"),
    )


def _records(s: Sessions, block: Column, apart: list[str]) -> DataFrame:
    """(doc, id, at, role, ts, kind, b, content): records in order from 0.  A block of the kinds in `apart` is one of its own,
    with b, that block's columns; other blocks of a message that follow one another are one, with their JSON in an array."""
    rows = s.blocks.where(F.col("type").isin("text", "thinking", "tool_use", "tool_result"))
    own = F.col("type").isin(apart) if apart else F.lit(False)
    order = Window.partitionBy("doc", "msg_idx").orderBy("block_idx")
    rows = rows.withColumn("own", own).withColumn("turn", F.sum(F.when(F.col("own"), 2).otherwise(0)).over(order) - F.when(F.col("own"), 1).otherwise(0))
    names = ["type", "text", "tool_id", "tool_name", "tool_input_json", "result_text", "result_json", "is_error"]
    rows = rows.withColumn("json", F.struct("block_idx", block.alias("x")))
    held = rows.groupBy("doc", "msg_idx", "turn").agg(F.first("role").alias("role"), F.first("ts").alias("ts"), F.first("own").alias("own"), F.first(F.struct(*names)).alias("b"), F.collect_list("json").alias("p"))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("msg_idx", "turn")) - 1
    content = F.transform(F.array_sort("p", lambda a, b: a["block_idx"] - b["block_idx"]), lambda x: x["x"])
    held = held.select("doc", at.alias("at"), "role", "ts", F.when(F.col("own"), F.col("b.type")).alias("kind"), "b", content.alias("content"))
    return held.join(s.sessions.select("doc", "id"), "doc")


def _lines(rows: DataFrame) -> DataFrame:
    """(id, line_no, line) as parsed lines of files that are named by ids."""
    return parsed(rows.select(F.concat(F.lit("/sessions/"), "id", F.lit(".jsonl")).alias("file"), "line_no", "line"))


def _whole_files(rows: DataFrame) -> DataFrame:
    return parsed(rows.select(F.concat(F.lit("/sessions/"), "id", F.lit(".json")).alias("file"), F.lit(0).alias("line_no"), "line")).drop("line_no")


def _collected(rows: DataFrame, order: str, value: Column) -> DataFrame:
    """(id, items): a session's values in order."""
    held = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(value).alias("x")))).alias("p"))
    return held.select("id", F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["x"]), ","), F.lit("]")).alias("items"))


def _documents(s: Sessions, items: DataFrame, key: str, **fields: Column) -> DataFrame:
    """One JSON document for each session: its fields, then the items under a key."""
    rows = s.sessions.join(items.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    body = F.parse_json(F.coalesce("items", F.lit("[]")))
    return _whole_files(rows.select("id", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], body.alias(key))).alias("line")))


def pi(s: Sessions) -> Tables:
    call = _block(call="toolCall", given="arguments")
    rows = _records(s, call, ["tool_result"])
    result = F.col("kind") == "tool_result"
    texts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("b.result_text", "b.result_json", F.lit("")).alias("text")))
    said = F.struct(F.lit("message").alias("type"), _time("ts").alias("timestamp"), F.struct("role", F.col("content").alias("content")).alias("message"))
    told = F.struct(F.lit("message").alias("type"), _time("ts").alias("timestamp"), F.struct(F.lit("toolResult").alias("role"), F.col("b.tool_id").alias("toolCallId"), texts.alias("content"), F.col("b.is_error").alias("isError")).alias("message"))
    body = rows.select("id", (F.col("at") + 1).alias("line_no"), F.when(result, F.to_json(told)).otherwise(F.to_json(said)).alias("line"))
    head = F.to_json(F.struct(F.lit("session").alias("type"), "id", "cwd", _time("ts").alias("timestamp")))
    return {"lines": _lines(s.sessions.select("id", F.lit(0).alias("line_no"), head.alias("line")).unionByName(body))}


def codex(s: Sessions) -> Tables:
    """Bash calls are shell commands; results are the ends of commands, with exit code 1 for an error."""
    rows = _records(s, F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), "text"), ["thinking", "tool_use", "tool_result"])
    b = lambda name: F.col(f"b.{name}")
    command = F.get_json_object("b.tool_input_json", "$.command")
    shell = (b("tool_name") == "Bash") & command.isNotNull()
    given = F.when(shell, F.to_json(F.struct(command.alias("cmd")))).otherwise(F.coalesce(b("tool_input_json"), F.lit("{}")))
    payload = (
        F.when(F.col("kind") == "tool_use", F.to_json(F.struct(F.lit("function_call").alias("type"), b("tool_id").alias("call_id"), F.when(shell, "exec_command").otherwise(b("tool_name")).alias("name"), given.alias("arguments"))))
        .when(F.col("kind") == "tool_result", F.to_json(F.struct(F.lit("exec_command_end").alias("type"), b("tool_id").alias("call_id"), F.coalesce(b("result_text"), b("result_json"), F.lit("")).alias("aggregated_output"), F.when(b("is_error"), 1).otherwise(0).alias("exit_code"))))
        .when(F.col("kind") == "thinking", F.to_json(F.struct(F.lit("reasoning").alias("type"), F.array(F.struct(F.lit("summary_text").alias("type"), b("text").alias("text"))).alias("summary"))))
        .otherwise(F.to_json(F.struct(F.lit("message").alias("type"), "role", "content")))
    )
    kind = F.when(F.col("kind") == "tool_result", "event_msg").otherwise("response_item")
    body = rows.select("id", (F.col("at") + 1).alias("line_no"), F.to_json(F.struct(_time("ts").alias("timestamp"), kind.alias("type"), F.parse_json(payload).alias("payload"))).alias("line"))
    meta = F.struct("id", "cwd", _time("ts").alias("timestamp"), "cli_version", "model", F.struct(F.col("branch").alias("branch")).alias("git"))
    head = F.to_json(F.struct(_time("ts").alias("timestamp"), F.lit("session_meta").alias("type"), meta.alias("payload")))
    return {"lines": _lines(s.sessions.select("id", F.lit(0).alias("line_no"), head.alias("line")).unionByName(body))}


def amp(s: Sessions) -> Tables:
    run = F.struct(F.when(F.col("is_error"), "error").otherwise("done").alias("status"), F.when(~F.col("is_error"), _result()).alias("result"), F.when(F.col("is_error"), _result()).alias("error"))
    plain = F.struct(
        F.col("type"),
        F.when(_is("text"), F.col("text")).alias("text"),
        F.when(_is("thinking"), F.col("text")).alias("thinking"),
        F.when(_is("tool_use"), F.col("tool_id")).alias("id"),
        F.when(_is("tool_use"), F.col("tool_name")).alias("name"),
        F.when(_is("tool_use"), _input()).alias("input"),
        F.when(_is("tool_result"), F.col("tool_id")).alias("toolUseID"),
        F.when(_is("tool_result"), run).alias("run"),
    )
    rows = _records(s, plain, [])
    user = F.col("role") == "user"
    m = F.struct("role", F.when(user, F.struct(_millis("ts").alias("sentAt"))).alias("meta"), F.when(~user, F.struct(_time("ts").alias("timestamp"))).alias("usage"), "content")
    return {"docs": _documents(s, _collected(rows, "at", m), "messages", id=F.col("id"), created=_millis("ts"), title=F.col("title"))}


def cowork_remote(s: Sessions) -> Tables:
    rows = _records(s, _block(), [])
    event = F.struct(F.concat(F.lit("event-"), "at").alias("event_id"), F.col("role").alias("type"), _time("ts").alias("created_at"), F.struct("role", "content").alias("message"))
    return {"docs": _documents(s, _collected(rows, "at", event), "events", id=F.col("id"), title=F.col("title"), created_at=_time("ts"))}


def claude_chat(s: Sessions) -> Tables:
    """A chain of messages whose last one is the current leaf."""
    rows = _records(s, _block(), [])
    rows = rows.withColumn("last", F.max("at").over(Window.partitionBy("doc")))
    name = lambda n: F.concat(F.lit("m-"), n)
    m = F.struct(name(F.col("at")).alias("uuid"), F.when(F.col("at") > 0, name(F.col("at") - 1)).alias("parent_message_uuid"), F.when(F.col("role") == "user", "human").otherwise("assistant").alias("sender"), _time("ts").alias("created_at"), "content")
    leaves = rows.groupBy("id").agg(F.max("at").alias("leaf"))
    own = Sessions(s.sessions.join(leaves, "id", "left"), s.blocks)
    return {"docs": _documents(own, _collected(rows, "at", m), "chat_messages", uuid=F.col("id"), name=F.col("title"), created_at=_time("ts"), model=F.col("model"), current_leaf_message_uuid=name(F.col("leaf")))}


def chatgpt(s: Sessions) -> Tables:
    """A chain under a root without a message; a call is a message to its tool, named by the call's id, so a result's id is that
    of the call before it."""
    rows = _records(s, F.struct("text"), ["text", "thinking", "tool_use", "tool_result"])
    rows = rows.withColumn("node", F.when(F.col("kind") == "tool_use", F.concat("b.tool_id", F.lit("@"), "at")).otherwise(F.concat(F.lit("m-"), "at")))
    rows = rows.withColumns({"before": F.lag("node").over(Window.partitionBy("doc").orderBy("at")), "n": F.max("at").over(Window.partitionBy("doc"))})
    b = lambda name: F.col(f"b.{name}")
    body = F.coalesce(b("text"), b("tool_input_json"), b("result_text"), b("result_json"), F.lit(""))
    who = F.when(F.col("kind") == "tool_result", "tool").otherwise(F.col("role"))
    content = F.struct(F.when(F.col("kind") == "thinking", "thoughts").otherwise("text").alias("content_type"), F.array(body).alias("parts"))
    message = F.struct(F.when(F.col("kind") == "tool_use", b("tool_id")).otherwise(F.col("node")).alias("id"), F.struct(who.alias("role")).alias("author"), (_millis("ts") / 1000).alias("create_time"), content.alias("content"), F.when(F.col("kind") == "tool_use", b("tool_name")).otherwise("all").alias("recipient"), F.struct(b("is_error").alias("is_error")).alias("metadata"))
    node = F.struct(F.col("node").alias("id"), F.coalesce("before", F.lit("root")).alias("parent"), message.alias("message"))
    held = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("node", node.alias("x")))).alias("m"), F.max(F.struct("at", "node"))["node"].alias("leaf"))
    out = s.sessions.join(held, "id", "left").select("id", F.to_json(F.struct(F.col("id").alias("conversation_id"), "title", (_millis("ts") / 1000).alias("create_time"), F.col("leaf").alias("current_node"), F.col("m").alias("mapping"))).alias("line"))
    return {"docs": _whole_files(out)}


def freebuff(s: Sessions) -> Tables:
    rows = _records(s, _block(), [])
    messages = rows.select(F.col("id").alias("thread_id"), F.col("at").alias("seq"), "role", F.to_json("content").alias("parts"), _millis("ts").alias("created_at"))
    return {"threads": s.sessions.select("id", "title", "cwd", _millis("ts").alias("created_at")), "messages": messages}


def hermes(s: Sessions) -> Tables:
    """A call, a result and a text are rows of their own; the format has no sign of an error."""
    rows = _records(s, F.struct("text"), ["text", "thinking", "tool_use", "tool_result"])
    b = lambda name: F.col(f"b.{name}")
    tool, given = _native_tool("hermes")
    named = rows.select("*", "b.tool_name", "b.tool_input_json").withColumns({"native": tool, "given": given})
    call = F.to_json(F.array(F.struct(b("tool_id").alias("id"), F.struct(F.col("native").alias("name"), F.col("given").alias("arguments")).alias("function"))))
    kind = F.col("kind")
    messages = named.select(
        (F.col("at") + 1).alias("id"),
        F.col("id").alias("session_id"),
        F.when(kind == "tool_result", "tool").otherwise(F.col("role")).alias("role"),
        F.when(kind == "text", b("text")).when(kind == "tool_result", F.coalesce(b("result_text"), b("result_json"))).alias("content"),
        F.when(kind == "tool_result", b("tool_id")).alias("tool_call_id"),
        F.when(kind == "tool_use", call).alias("tool_calls"),
        F.when(kind == "thinking", b("text")).alias("reasoning"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"),
        F.lit(1).alias("active"),
    )
    return {"sessions": s.sessions.select("id", "title", "model", (F.unix_micros("ts") / 1e6).alias("started_at"), F.lit(0).alias("archived")), "messages": messages}


def cursor(s: Sessions) -> Tables:
    rows = _records(s, F.struct(F.when(_is("thinking"), "reasoning").otherwise("text").alias("type"), "text"), ["tool_use", "tool_result"])
    b = lambda name: F.col(f"b.{name}")
    own = rows.select("*", "b.result_text", "b.result_json", "b.tool_input_json")
    call = F.array(F.struct(F.lit("tool-call").alias("type"), b("tool_id").alias("toolCallId"), b("tool_name").alias("toolName"), _input().alias("args")))
    result = F.array(F.struct(F.lit("tool-result").alias("type"), b("tool_id").alias("toolCallId"), _result().alias("result"), b("is_error").alias("isError")))
    kind = F.col("kind")
    data = F.when(kind == "tool_use", F.to_json(F.struct(F.lit("assistant").alias("role"), call.alias("content")))).when(kind == "tool_result", F.to_json(F.struct(F.lit("tool").alias("role"), result.alias("content")))).otherwise(F.to_json(F.struct("role", "content")))
    return {"sessions": s.sessions.select("id", "title", "cwd", "model", _millis("ts").alias("created_at")), "blobs": own.select(F.col("id").alias("session_id"), F.col("at").alias("rowid"), data.alias("data"))}


def opencode(s: Sessions) -> Tables:
    """A call and the result of the same id in a message after it are one part, so only those results are written that have a
    call; a message holds one part of a tool, or texts."""
    rows = _records(s, F.struct("text"), ["text", "thinking", "tool_use", "tool_result"])
    b = lambda name: F.col(f"b.{name}")
    tool, given = _native_tool("opencode")
    results = rows.where("kind = 'tool_result'").groupBy("doc", F.col("b.tool_id").alias("call")).agg(F.min_by("b", "at").alias("r"))
    rows = rows.where("kind <> 'tool_result'").withColumn("call", F.when(F.col("kind") == "tool_use", b("tool_id"))).join(results, ["doc", "call"], "left")
    rows = rows.select("*", "b.tool_name", "b.tool_input_json").withColumns({"native": tool, "given": given})
    failed = F.col("r.is_error")
    output = F.coalesce("r.result_text", "r.result_json")
    state = F.struct(F.when(F.col("r").isNull(), "pending").when(failed, "error").otherwise("completed").alias("status"), F.parse_json("given").alias("input"), F.when(~failed, output).alias("output"), F.when(failed, output).alias("error"))
    data = F.when(F.col("kind") == "tool_use", F.to_json(F.struct(F.lit("tool").alias("type"), F.col("native").alias("tool"), F.col("call").alias("callID"), state.alias("state")))).otherwise(F.to_json(F.struct(F.when(F.col("kind") == "thinking", "reasoning").otherwise("text").alias("type"), b("text").alias("text"))))
    mid = F.concat(F.col("id"), F.lit("-"), F.lpad(F.col("at").cast("string"), 9, "0"))
    message = rows.select(mid.alias("id"), F.col("id").alias("session_id"), _millis("ts").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    part = rows.select(F.concat(mid, F.lit("-0")).alias("id"), mid.alias("message_id"), data.alias("data"))
    session = s.sessions.select("id", F.col("cwd").alias("directory"), "title", F.col("cli_version").alias("version"), _millis("ts").alias("time_created"), F.lit(None).cast("long").alias("time_archived"))
    return {"session": session, "message": message, "part": part}


WRITERS: dict[str, Callable[[Sessions], Tables]] = {f.__name__: f for f in (pi, codex, amp, cowork_remote, claude_chat, chatgpt, freebuff, hermes, cursor, opencode)} | {"campfire": pi}


def native_tables(s: Sessions, target: str) -> Tables:
    """The native tables of sessions in a format."""
    if target not in WRITERS:
        raise ValueError(f"no writer for {target!r}: {', '.join(sorted(WRITERS))}")
    return WRITERS[target](s)


def save(s: Sessions, target: str, path: str) -> None:
    """Writes native tables under path, lines and documents as text, always as a new copy; an existing path is an error."""
    for name, table in native_tables(s, target).items():
        if name in ("lines", "docs"):
            line = F.to_json("v").alias("value")
            order = ["file", "line_no"] if name == "lines" else ["file"]
            table.repartition("file").sortWithinPartitions(*order).select("stem", line).write.mode("error").partitionBy("stem").text(f"{path}/{name}")
        else:
            table.write.mode("error").parquet(f"{path}/{name}")

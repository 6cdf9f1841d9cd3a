"""Adapters of transcript formats to the canonical tables: JSON lines, JSON documents, trees and exported tables.

Each takes native rows (from read_lines, read_documents, or tables exported from a store's database) and returns Sessions.
A block's JSON stays canonical text; malformed records are left out, never a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions.ids import uuid5
from ..plans import canonical as c
from .base import Sessions, adapter, block_table, carried, first_value, last_value, number_messages

_V = F.col


def _content(content: Column, path: str) -> Column:
    """A message's blocks: an array as it is, a string as one text block, anything else as none."""
    one = F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), J.text_at(content, path).alias("text")))))
    empty = F.array().cast("array<variant>")
    return F.when(J.is_string(content, path), F.when(J.text_at(content, path) != "", one).otherwise(empty)).otherwise(F.coalesce(J.array_at(content, path), empty))


def _blocks(b: Column, thinking: str = "thinking", result_id: str = "tool_use_id") -> dict[str, Column]:
    """Canonical columns of a block in the widespread form type/text/thinking/tool_use/tool_result/image."""
    kind = J.text_at(b, "$.type")
    is_text, is_think, is_call, is_result = (kind == k for k in ("text", "thinking", "tool_use", "tool_result"))
    return {
        "type": kind,
        "text": F.when(is_text, J.text_at(b, "$.text")).when(is_think, J.text_at(b, f"$.{thinking}")),
        "tool_id": F.when(is_call, J.text_at(b, "$.id")).when(is_result, J.text_at(b, f"$.{result_id}")),
        "tool_name": F.when(is_call, J.text_at(b, "$.name")),
        "tool_input_json": F.when(is_call, F.coalesce(J.json_at(b, "$.input"), F.lit("{}"))),
        "result_text": F.when(is_result, F.when(F.try_variant_get(b, "$.content", "variant").isNull(), "").otherwise(J.text_at(b, "$.content"))),
        "result_json": F.when(is_result & ~J.is_string(b, "$.content"), J.json_at(b, "$.content")),
        "is_error": F.when(is_result, J.bool_at(b, "$.is_error")).otherwise(F.lit(False)),
    }


def _whole(rows: DataFrame) -> DataFrame:
    """Blocks that have what their kind needs."""
    return rows.where("""(type in ('text', 'thinking') and text is not null) or (type = 'tool_use' and tool_id is not null and tool_name is not null)
        or (type = 'tool_result' and tool_id is not null) or type in ('image', 'artifact')""")


@adapter("simple")
def simple(docs: DataFrame, default_ts: str = "1970-01-01T00:00:00Z") -> Sessions:
    """One JSON document a session: metadata beside `messages`.  Results without an id answer the oldest open call.

    A document without a messages array is left out.  default_ts stands for a missing timestamp."""
    v = _V("v")
    rows = docs.where(J.array_at(v, "$.messages").isNotNull())
    rows = rows.withColumn("id", F.coalesce(F.nullif(J.text_at(v, "$.id"), F.lit("")), _V("stem"))).withColumn("doc", c.doc_key(F.lit("simple"), _V("id")))
    rows = rows.withColumn("ts0", F.coalesce(J.timestamp(J.text_at(v, "$.timestamp")), J.timestamp(F.lit(default_ts))))
    meta = c.sessions(rows, id=_V("id"), ts=_V("ts0"), **{k: J.text_at(v, f"$.{n}") for k, n in (("cwd", "cwd"), ("branch", "git_branch"), ("title", "title"), ("cli_version", "cli_version"), ("model", "model"))}, source=F.lit(None), seq=F.xxhash64("id"))
    m = rows.select("doc", "id", "ts0", F.posexplode(J.array_at(v, "$.messages")).alias("i", "m"))
    m = m.withColumn("role", F.lower(F.trim(J.text_at(_V("m"), "$.role")))).where(F.col("role").isin("user", "assistant"))
    m = m.withColumn("ts", F.coalesce(carried(J.timestamp(J.text_at(_V("m"), "$.timestamp")), ["i"]), "ts0"))
    one = F.array(F.parse_json(F.to_json(F.struct(F.lit("text").alias("type"), J.text_at(_V("m"), "$.content").alias("text")))))
    content = F.when(J.is_string(_V("m"), "$.content"), one).otherwise(J.array_at(_V("m"), "$.content"))
    b = m.select("doc", "id", "i", "role", "ts", F.posexplode(content).alias("j", "b"))
    b = b.select("doc", "id", "i", "j", "role", "ts", *[x.alias(k) for k, x in _blocks(_V("b"), "text").items()])
    b = b.withColumn("made", uuid5(F.concat_ws(":", "id", "i", "j")))
    b = b.where("(type in ('text', 'thinking') and text is not null) or (type = 'tool_use' and tool_name is not null) or type in ('tool_result', 'image', 'artifact')")
    ids = b.where("type in ('tool_use', 'tool_result')").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "j", (F.col("type") == "tool_use").alias("call"), F.col("tool_id").alias("own"), "made"))).alias("e"))
    answered = ids.select("doc", F.explode(_fifo(_V("e"))).alias("r")).select("doc", "r.*").withColumnRenamed("tool_id", "paired")
    b = b.join(answered, ["doc", "i", "j"], "left").withColumn("tool_id", F.coalesce("paired", "tool_id"))
    return Sessions(meta, block_table(number_messages(b, ["i"], "j")))


def _fifo(events: Column) -> Column:
    """Ids of calls and results (i, j, call, own, made), in order, as (i, j, tool_id).

    A call waits in a queue under its own id or a made one; a result with an id takes that out of the queue, a result without
    takes the queue's head, or a made id if it is empty.  The queue is a session's open calls."""
    zero = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<struct<i:int,j:int,tool_id:string>>").alias("out"))

    def step(a, x):
        at = F.array_position(a["open"], x["own"])
        rest = F.when(at > 0, F.concat(F.slice(a["open"], F.lit(1), (at - 1).cast("int")), F.slice(a["open"], (at + 1).cast("int"), F.size(a["open"])))).otherwise(a["open"])
        found = F.when(x["call"], F.coalesce(x["own"], x["made"])).otherwise(F.coalesce(x["own"], F.get(a["open"], F.lit(0)), x["made"]))
        queue = F.when(x["call"], F.array_append(a["open"], F.coalesce(x["own"], x["made"]))).when(x["own"].isNotNull(), rest).otherwise(F.slice(a["open"], F.lit(2), F.greatest(F.size(a["open"]), F.lit(1))))
        return F.struct(queue.alias("open"), F.array_append(a["out"], F.struct(x["i"].cast("int").alias("i"), x["j"].cast("int").alias("j"), found.alias("tool_id"))).alias("out"))

    return F.aggregate(events, zero, step)["out"]


@adapter("claude_code")
def claude_code(lines: DataFrame, harness: str = "claude_code") -> Sessions:
    """JSON lines, one file a session.  Metadata: the first id, cwd, branch, version and model; the earliest time; the last
    custom title, else the first summary."""
    v, order = _V("v"), _V("line_no")
    kind = J.text_at(v, "$.type")
    user, assistant = kind == "user", kind == "assistant"
    custom = last_value(J.text_at(v, "$.customTitle"), order, kind == "custom-title")
    agent = last_value(J.text_at(v, "$.agentName"), order, kind == "agent-name")
    meta = lines.groupBy("file", "stem").agg(
        first_value(J.text_at(v, "$.sessionId"), order, user).alias("sid"),
        first_value(J.text_at(v, "$.cwd"), order, user).alias("cwd"),
        first_value(J.text_at(v, "$.gitBranch"), order, user).alias("branch"),
        first_value(J.text_at(v, "$.version"), order, user).alias("cli_version"),
        first_value(J.text_at(v, "$.message.model"), order, assistant).alias("model"),
        F.min(F.when(user | assistant, J.timestamp(J.text_at(v, "$.timestamp")))).alias("ts"),
        F.coalesce(custom, agent, first_value(J.text_at(v, "$.summary"), order, kind == "summary")).alias("title"),
    )
    meta = meta.withColumn("id", F.coalesce(F.nullif("sid", F.lit("")), "stem")).withColumn("doc", c.doc_key(F.lit(harness), _V("id")))
    rows = lines.where(user | assistant).join(meta.select("file", "doc", F.col("ts").alias("ts0")), "file")
    rows = rows.select("doc", "line_no", kind.alias("role"), F.coalesce(J.timestamp(J.text_at(v, "$.timestamp")), "ts0").alias("ts"), F.posexplode(_content(v, "$.message.content")).alias("j", "b"))
    rows = _whole(rows.select("doc", "line_no", "role", "ts", "j", *[x.alias(k) for k, x in _blocks(_V("b")).items()]))
    out = c.sessions(meta, harness=F.lit(harness), id=_V("id"), source=F.lit(None), ts=_V("ts"), cwd=_V("cwd"), branch=_V("branch"), title=_V("title"), cli_version=_V("cli_version"), model=_V("model"), seq=F.xxhash64("doc"))
    return Sessions(out, block_table(number_messages(rows, ["line_no"], "j")))


@adapter("pi")
def pi(lines: DataFrame, harness: str = "pi") -> Sessions:
    """JSON lines with a header line; results and shell runs are records of their own; the last model change is the model."""
    v, order = _V("v"), _V("line_no")
    kind = J.text_at(v, "$.type")
    head = kind == "session"
    meta = lines.groupBy("file", "stem").agg(
        last_value(J.text_at(v, "$.id"), order, head).alias("sid"),
        last_value(J.text_at(v, "$.cwd"), order, head).alias("cwd"),
        last_value(J.text_at(v, "$.parentSession"), order, head).alias("parent"),
        last_value(J.timestamp(J.text_at(v, "$.timestamp")), order, head).alias("ts"),
        last_value(J.text_at(v, "$.modelId"), order, kind == "model_change").alias("model"),
        F.nullif(F.trim(last_value(F.coalesce(J.text_at(v, "$.name"), F.lit("")), order, kind == "session_info")), F.lit("")).alias("title"),
    )
    meta = meta.withColumn("id", F.coalesce(F.nullif("sid", F.lit("")), "stem")).withColumn("doc", c.doc_key(F.lit(harness), _V("id")))
    rows = lines.join(meta.select("file", "doc", F.col("ts").alias("ts0")), "file")
    rows = rows.withColumn("ts", F.coalesce(J.timestamp(J.text_at(v, "$.timestamp")), "ts0")).withColumn("role", J.text_at(v, "$.message.role"))
    said = rows.where((kind == "message") & F.col("role").isin("user", "assistant"))
    custom = rows.where(kind == "custom_message").withColumn("role", F.lit("user"))
    parts = said.select("doc", "line_no", F.lit(0).alias("sub"), "role", "ts", F.posexplode(_content(v, "$.message.content")).alias("j", "b")).unionByName(custom.select("doc", "line_no", F.lit(0).alias("sub"), "role", "ts", F.posexplode(_content(v, "$.content")).alias("j", "b")))
    call = J.text_at(_V("b"), "$.type") == "toolCall"
    own = _blocks(_V("b"))
    own["type"] = F.when(call, "tool_use").otherwise(own["type"])
    own["tool_id"] = F.when(call, J.text_at(_V("b"), "$.id")).otherwise(own["tool_id"])
    own["tool_name"] = F.when(call, J.text_at(_V("b"), "$.name")).otherwise(own["tool_name"])
    own["tool_input_json"] = F.when(call, F.coalesce(J.json_at(_V("b"), "$.arguments"), F.lit("{}"))).otherwise(own["tool_input_json"])
    blocks = _whole(parts.select("doc", "line_no", "sub", "role", "ts", "j", *[x.alias(k) for k, x in own.items()]))
    texts = F.array_join(F.transform(F.coalesce(J.array_at(v, "$.message.content"), F.array().cast("array<variant>")), lambda x: F.coalesce(J.text_at(x, "$.text"), F.lit(""))), "\n")
    result = rows.where((kind == "message") & (F.col("role") == "toolResult")).select("doc", "line_no", F.lit(0).alias("sub"), F.lit("user").alias("role"), "ts", F.lit(0).alias("j"), F.lit("tool_result").alias("type"), F.coalesce(J.text_at(v, "$.message.toolCallId"), F.lit("")).alias("tool_id"), F.coalesce(J.text_at(v, "$.message.content"), texts).alias("result_text"), J.bool_at(v, "$.message.isError").alias("is_error"))
    shell = rows.where((kind == "message") & (F.col("role") == "bashExecution"))
    shell = shell.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("line_no"))).withColumn("command", J.text_at(v, "$.message.command")).where("command <> ''").where(~J.bool_at(v, "$.message.excludeFromContext"))
    run_id = F.concat(F.lit("bash_exec_"), "seq")
    calls = shell.select("doc", "line_no", F.lit(0).alias("sub"), F.lit("assistant").alias("role"), "ts", F.lit(0).alias("j"), F.lit("tool_use").alias("type"), run_id.alias("tool_id"), F.lit("Bash").alias("tool_name"), F.to_json(F.struct("command")).alias("tool_input_json"), F.lit(False).alias("is_error"))
    outputs = shell.select("doc", "line_no", F.lit(1).alias("sub"), F.lit("user").alias("role"), "ts", F.lit(0).alias("j"), F.lit("tool_result").alias("type"), run_id.alias("tool_id"), F.coalesce(J.text_at(v, "$.message.output"), F.lit("")).alias("result_text"), F.coalesce(J.long_at(v, "$.message.exitCode") != 0, F.lit(False)).alias("is_error"))
    every = blocks
    for more in (result, calls, outputs):
        every = every.unionByName(more, allowMissingColumns=True)
    out = c.sessions(meta, harness=F.lit(harness), id=_V("id"), source=F.lit(None), ts=_V("ts"), cwd=_V("cwd"), title=_V("title"), model=_V("model"), seq=F.xxhash64("doc"))
    return Sessions(out, block_table(number_messages(every, ["line_no", "sub"], "j")))


@adapter("campfire")
def campfire(lines: DataFrame) -> Sessions:
    """The pi format under another root."""
    return pi(lines, "campfire")


@adapter("cowork")
def cowork(lines: DataFrame, headers: DataFrame) -> Sessions:
    """Claude lines with a header document (id, title, cwd, model, createdAt in milliseconds) for each session, by id."""
    found = claude_code(lines, "cowork")
    v = _V("v")
    h = headers.select(J.text_at(v, "$.cliSessionId").alias("id"), J.text_at(v, "$.title").alias("h_title"), J.text_at(v, "$.cwd").alias("h_cwd"), J.text_at(v, "$.model").alias("h_model"), J.epoch(J.long_at(v, "$.createdAt"), "ms").alias("h_ts")).where("id is not null")
    s = found.sessions.join(h, "id", "left")
    s = s.withColumns({"title": F.coalesce("h_title", "title"), "cwd": F.coalesce("h_cwd", "cwd"), "model": F.coalesce("model", "h_model"), "ts": F.coalesce("ts", "h_ts")})
    return Sessions(s.select(*c.SESSION_COLUMNS), found.blocks)


@adapter("amp")
def amp(docs: DataFrame) -> Sessions:
    """One JSON document a thread; times are carried forward; a result's state is its run's."""
    v = _V("v")
    rows = docs.withColumn("id", F.coalesce(J.text_at(v, "$.id"), "stem")).withColumn("doc", c.doc_key(F.lit("amp"), _V("id"))).withColumn("ts0", J.epoch(J.long_at(v, "$.created"), "ms"))
    meta = c.sessions(rows, harness=F.lit("amp"), id=_V("id"), source=F.lit(None), ts=_V("ts0"), title=J.text_at(v, "$.title"), seq=F.xxhash64("doc"))
    m = rows.select("doc", "ts0", F.posexplode(J.array_at(v, "$.messages")).alias("i", "m")).withColumn("role", J.text_at(_V("m"), "$.role")).where("role in ('user', 'assistant')")
    at = F.when(F.col("role") == "user", J.epoch(J.long_at(_V("m"), "$.meta.sentAt"), "ms")).otherwise(J.timestamp(J.text_at(_V("m"), "$.usage.timestamp")))
    m = m.withColumn("ts", F.coalesce(carried(at, ["i"]), "ts0"))
    b = m.select("doc", "i", "role", "ts", F.posexplode(_content(_V("m"), "$.content")).alias("j", "b"))
    own = _blocks(_V("b"), result_id="toolUseID")
    result, status = own["type"] == "tool_result", J.text_at(_V("b"), "$.run.status")
    reason = lambda other: F.coalesce(J.text_at(_V("b"), "$.run.reason"), F.lit(other))
    own["result_text"] = F.when(result, F.when(status == "done", J.text_at(_V("b"), "$.run.result")).when(status == "error", F.coalesce(J.text_at(_V("b"), "$.run.error.message"), J.text_at(_V("b"), "$.run.error"), J.json_at(_V("b"), "$.run.error"), F.lit(""))).when(status == "cancelled", reason("cancelled")).when(status == "rejected-by-user", reason("rejected by user")))
    own["result_json"] = F.when(result & own["result_text"].isNull(), F.when(status == "done", F.coalesce(J.json_at(_V("b"), "$.run.result"), F.lit("null"))).otherwise(J.json_at(_V("b"), "$.run")))
    own["is_error"] = F.coalesce(result & status.isin("error", "cancelled", "rejected-by-user"), F.lit(False))
    b = _whole(b.select("doc", "i", "role", "ts", "j", *[x.alias(k) for k, x in own.items()])).where("type not in ('text', 'thinking') or trim(text) <> ''")
    return Sessions(meta, block_table(number_messages(b, ["i"], "j")))


@adapter("opencode")
def opencode(session: DataFrame, message: DataFrame, part: DataFrame) -> Sessions:
    """Exported tables: session(id, directory, title, version, time_created, time_archived), message(id, session_id,
    time_created, data) and part(id, message_id, data).  Archived sessions are left out.  An assistant's parts become
    messages: texts up to a tool part together, each call and each result alone."""
    s = session.where("time_archived is null").withColumn("doc", c.doc_key(F.lit("opencode"), _V("id")))
    meta = c.sessions(s, harness=F.lit("opencode"), id=_V("id"), source=F.lit(None), ts=F.timestamp_millis("time_created"), cwd=_V("directory"), title=_V("title"), cli_version=_V("version"), seq=F.xxhash64("doc"))
    m = message.select(F.col("id").alias("mid"), F.col("session_id").alias("sid"), F.col("time_created").alias("t"), J.parse(_V("data")).alias("info")).where("info is not null")
    p = part.select(F.col("id").alias("pid"), F.col("message_id").alias("mid"), J.parse(_V("data")).alias("p")).where("p is not null")
    rows = s.select(F.col("id").alias("sid"), "doc").join(m, "sid").join(p, "mid").withColumn("role", J.text_at(_V("info"), "$.role")).where("role in ('user', 'assistant')")
    kind = J.text_at(_V("p"), "$.type")
    state, status = "$.state", J.text_at(_V("p"), "$.state.status")
    rows = rows.withColumn("kind", kind).where(F.col("kind").isin("text", "reasoning", "tool") & ~(J.bool_at(_V("p"), "$.synthetic") & (F.col("kind") == "text")))
    rows = rows.where((F.col("kind") == "tool") & (F.col("role") == "assistant") & J.text_at(_V("p"), "$.tool").isNotNull() | (F.trim(J.text_at(_V("p"), "$.text")) != "") & ((F.col("role") == "assistant") | (F.col("kind") == "text")))
    order = Window.partitionBy("doc", "mid").orderBy("pid")
    # A tool part ends the texts before it: its place counts it twice, texts after it come next.
    turn = F.sum(F.when(F.col("kind") == "tool", 2).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("turn", turn - F.when(F.col("kind") == "tool", 1).otherwise(0))
    call_id = F.coalesce(J.text_at(_V("p"), "$.callID"), F.lit(""))
    base = ["doc", "t", "mid", "turn", "pid", F.timestamp_millis("t").alias("ts")]
    texts = rows.where("kind <> 'tool'").select(*base, F.lit(0).alias("sub"), "role", F.when(F.col("kind") == "text", "text").otherwise("thinking").alias("type"), J.text_at(_V("p"), "$.text").alias("text"), F.lit(False).alias("is_error"))
    tools = rows.where("kind = 'tool'")
    name, given = normalize_tool("opencode", J.text_at(_V("p"), "$.tool"), F.coalesce(J.json_at(_V("p"), f"{state}.input"), F.lit("{}")))
    calls = tools.select(*base, F.lit(0).alias("sub"), F.lit("assistant").alias("role"), F.lit("tool_use").alias("type"), call_id.alias("tool_id"), name.alias("tool_name"), given.alias("tool_input_json"), F.lit(False).alias("is_error"))
    failed = status == "error"
    body = F.when(failed, F.coalesce(J.text_at(_V("p"), f"{state}.error"), F.lit("Tool call failed"))).otherwise(F.when(F.try_variant_get(_V("p"), f"{state}.output", "variant").isNull(), "").otherwise(J.text_at(_V("p"), f"{state}.output")))
    results = tools.where(status.isin("completed", "error")).select(*base, F.lit(1).alias("sub"), F.lit("user").alias("role"), F.lit("tool_result").alias("type"), call_id.alias("tool_id"), body.alias("result_text"), F.when(body.isNull(), J.json_at(_V("p"), f"{state}.output")).alias("result_json"), failed.alias("is_error"))
    every = texts.unionByName(calls, allowMissingColumns=True).unionByName(results, allowMissingColumns=True)
    return Sessions(meta, block_table(number_messages(every, ["t", "mid", "turn", "sub"], "pid")))


@adapter("freebuff")
def freebuff(threads: DataFrame, messages: DataFrame) -> Sessions:
    """Exported tables: threads(id, title, cwd, created_at in milliseconds) and messages(thread_id, seq, role, parts, created_at)."""
    s = threads.withColumn("doc", c.doc_key(F.lit("freebuff"), _V("id")))
    meta = c.sessions(s, harness=F.lit("freebuff"), id=_V("id"), source=F.lit(None), ts=F.timestamp_millis("created_at"), cwd=_V("cwd"), title=_V("title"), seq=F.xxhash64("doc"))
    m = s.select(F.col("id").alias("thread_id"), "doc").join(messages, "thread_id").withColumn("v", J.parse(_V("parts"))).where("role in ('user', 'assistant')")
    b = m.select("doc", "seq", "role", F.timestamp_millis("created_at").alias("ts"), F.posexplode(_content(_V("v"), "$")).alias("j", "b"))
    b = _whole(b.select("doc", "seq", "role", "ts", "j", *[x.alias(k) for k, x in _blocks(_V("b")).items()]))
    return Sessions(meta, block_table(number_messages(b, ["seq"], "j")))


@adapter("hermes")
def hermes(sessions: DataFrame, messages: DataFrame) -> Sessions:
    """Exported tables: sessions(id, title, model, started_at, archived) and messages(id, session_id, role, content,
    tool_call_id, tool_calls, reasoning, timestamp, active).  Inactive rows and archived sessions are left out; content that
    is a JSON array or object is blocks or a JSON result, other content is text."""
    s = sessions.where("coalesce(archived, 0) = 0").withColumn("doc", c.doc_key(F.lit("hermes"), _V("id")))
    meta = c.sessions(s, harness=F.lit("hermes"), id=_V("id"), source=F.lit(None), ts=J.epoch(_V("started_at")), title=_V("title"), model=_V("model"), seq=F.xxhash64("doc"))
    m = s.select(F.col("id").alias("session_id"), "doc").join(messages.withColumnRenamed("id", "mid"), "session_id").where("coalesce(active, 1) <> 0").withColumn("ts", J.epoch(_V("timestamp")))
    said = m.where("role in ('user', 'assistant')")
    base = ["doc", "mid", "ts"]
    thinking = said.where("role = 'assistant' and trim(reasoning) <> ''").select(*base, "role", F.lit(0).alias("j"), F.lit("thinking").alias("type"), F.col("reasoning").alias("text"))
    texts = said.where("trim(content) <> ''").select(*base, "role", F.lit(1).alias("j"), F.lit("text").alias("type"), F.col("content").alias("text"))
    calls = said.where("role = 'assistant'").select(*base, "role", F.posexplode(J.array_at(J.parse(_V("tool_calls")), "$")).alias("k", "b"))
    name, given = normalize_tool("hermes", J.text_at(_V("b"), "$.function.name"), F.coalesce(J.text_at(_V("b"), "$.function.arguments"), J.json_at(_V("b"), "$.function.arguments"), F.lit("{}")))
    calls = calls.select(*base, "role", (F.col("k") + 2).alias("j"), F.lit("tool_use").alias("type"), J.text_at(_V("b"), "$.id").alias("tool_id"), name.alias("tool_name"), given.alias("tool_input_json")).where("tool_name is not null")
    v = J.parse(_V("content"))
    shape = F.schema_of_variant(v)
    is_json = F.coalesce(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.lit(False))
    results = m.where("role = 'tool'").select(*base, F.lit("user").alias("role"), F.lit(0).alias("j"), F.lit("tool_result").alias("type"), F.col("tool_call_id").alias("tool_id"), F.when(~is_json, F.coalesce("content", F.lit(""))).alias("result_text"), F.when(is_json, F.to_json(v)).alias("result_json"))
    every = thinking
    for more in (texts, calls, results):
        every = every.unionByName(more, allowMissingColumns=True)
    return Sessions(meta, block_table(number_messages(every.withColumn("is_error", F.lit(False)), ["mid"], "j")))


@adapter("cowork_remote")
def cowork_remote(docs: DataFrame) -> Sessions:
    """Offline documents {id, title, created_at, events: [...]}: each event once; events of sub-agents are left out."""
    v = _V("v")
    rows = docs.withColumn("id", F.coalesce(J.text_at(v, "$.id"), "stem")).withColumn("doc", c.doc_key(F.lit("cowork_remote"), _V("id")))
    meta = c.sessions(rows, harness=F.lit("cowork_remote"), id=_V("id"), source=F.lit(None), ts=J.timestamp(J.text_at(v, "$.created_at")), title=J.text_at(v, "$.title"), seq=F.xxhash64("doc"))
    e = rows.select("doc", F.posexplode(J.array_at(v, "$.events")).alias("i", "e")).withColumn("event_id", F.coalesce(J.text_at(_V("e"), "$.event_id"), F.concat(F.lit("#"), "i")))
    first = F.row_number().over(Window.partitionBy("doc", "event_id").orderBy("i")) == 1
    e = e.withColumn("first", first).where(F.col("first") & F.try_variant_get(_V("e"), "$.parent_tool_use_id", "string").isNull())
    e = e.withColumn("role", J.text_at(_V("e"), "$.type")).where("role in ('user', 'assistant')")
    b = e.select("doc", "i", "role", J.timestamp(J.text_at(_V("e"), "$.created_at")).alias("ts"), F.posexplode(_content(_V("e"), "$.message.content")).alias("j", "b"))
    b = _whole(b.select("doc", "i", "role", "ts", "j", *[x.alias(k) for k, x in _blocks(_V("b")).items()]))
    return Sessions(meta, block_table(number_messages(b, ["i"], "j")))


def conflicting_events(docs: DataFrame) -> DataFrame:
    """(file, event_id) of events that a document has twice and not alike: an error for that document."""
    e = docs.select("file", F.explode(J.array_at(_V("v"), "$.events")).alias("e")).select("file", J.text_at(_V("e"), "$.event_id").alias("event_id"), F.xxhash64(F.to_json("e")).alias("h"))
    return e.where("event_id is not null").groupBy("file", "event_id").agg(F.count_distinct("h").alias("n")).where("n > 1").drop("n")


#: Native tool names by harness, and the canonical name of each.
TOOL_NAMES: dict[str, dict[str, str]] = {
    "opencode": {"bash": "Bash", "read": "Read", "write": "Write", "edit": "Edit"},
    "amp": {"Bash": "Bash", "Read": "Read", "create_file": "Write", "edit_file": "Edit"},
    "hermes": {"terminal": "Bash", "read_file": "Read", "write_file": "Write", "patch": "Edit"},
    "pi": {"bash": "Bash", "read": "Read", "write": "Write", "edit": "Edit"},
}
#: Native input keys by harness and native tool, and the canonical name of each.
TOOL_KEYS: dict[tuple[str, str], dict[str, str]] = {
    ("opencode", "read"): {"filePath": "file_path"},
    ("opencode", "write"): {"filePath": "file_path"},
    ("opencode", "edit"): {"filePath": "file_path", "oldString": "old_string", "newString": "new_string", "replaceAll": "replace_all"},
    ("opencode", "bash"): {"timeout": "timeout_ms"},
    ("hermes", "read_file"): {"path": "file_path"},
    ("hermes", "write_file"): {"path": "file_path"},
}


def normalize_tool(harness: str, name: Column, given: Column) -> tuple[Column, Column]:
    """Canonical name and input of a native call; unknown tools stay as they are."""
    out_name, out_input = name, given
    for native, canonical in TOOL_NAMES.get(harness, {}).items():
        keys = TOOL_KEYS.get((harness, native))
        renamed = J.rename_keys(given, keys) if keys else given
        out_input = F.when(name == native, renamed).otherwise(out_input)
        out_name = F.when(name == native, canonical).otherwise(out_name)
    return out_name, out_input

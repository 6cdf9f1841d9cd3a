"""Adapters of interleaved logs and key-value stores: results mirrored in two logs, bubbles in recorded order, queues by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans import canonical as c
from .base import Sessions, adapter, block_table, first_value, number_messages
from .transcripts import _content, _whole

_V = F.col
#: How texts of a setup message start.
SETUP = ["<environment_context>", "<permissions instructions>", "<collaboration_mode>", "<sandbox_mode>", "<approval_policy>"]


def shell_command(given: Column) -> Column:
    """The command of a shell call: cmd or command as text, or an argument list, `bash -lc X` as X."""
    v = J.parse(given)
    argv = F.coalesce(F.try_variant_get(v, "$.command", "array<string>"), F.try_variant_get(v, "$.cmd", "array<string>"))
    wrapped = (F.size(argv) == 3) & F.get(argv, F.lit(0)).rlike("(^|/)(ba|z)?sh$") & F.get(argv, F.lit(1)).isin("-lc", "-c")
    return F.coalesce(J.text_at(v, "$.cmd"), J.text_at(v, "$.command"), F.when(wrapped, F.get(argv, F.lit(2))).otherwise(F.array_join(argv, " ")))


@adapter("codex")
def codex(lines: DataFrame) -> Sessions:
    """JSON lines {timestamp, type, payload} of two interleaved logs.

    A call's output counts only where the other log has no result for the same occurrence of the call.  A search and
    its end are paired by action, the latest open one first.  Messages that are setup throughout are left out."""
    v, order = _V("v"), _V("line_no")
    kind = J.text_at(v, "$.type")
    head = kind == "session_meta"
    meta = lines.groupBy("file", "stem").agg(
        *[first_value(J.text_at(v, f"$.payload.{p}"), order, head).alias(n) for p, n in (("id", "sid"), ("cwd", "cwd"), ("git.branch", "branch"), ("cli_version", "cli_version"), ("model", "model"))],
        first_value(J.timestamp(J.text_at(v, "$.payload.timestamp")), order, head).alias("ts"),
        first_value(J.text_at(v, "$.payload.model"), order, kind == "turn_context").alias("turn_model"),
    )
    meta = meta.withColumn("id", F.coalesce(F.nullif("sid", F.lit("")), "stem")).withColumn("doc", c.doc_key(F.lit("codex"), _V("id")))
    rows = lines.join(meta.select("file", "doc", F.col("ts").alias("ts0")), "file").where(kind.isin("response_item", "event_msg"))
    rows = rows.select("doc", "line_no", F.coalesce(J.timestamp(J.text_at(v, "$.timestamp")), "ts0").alias("ts"), F.try_variant_get(v, "$.payload", "variant").alias("p"))
    rows = rows.withColumns({"k": J.text_at(_V("p"), "$.type"), "call_id": J.text_at(_V("p"), "$.call_id"), "action": F.coalesce(J.json_at(_V("p"), "$.action"), F.lit("null"))})
    # A search without an id and an end answer the latest open one of the other kind with their action, whichever comes first:
    # they are steps up and down, and two steps over the same edge, one after the other, are a pair.
    step = F.when((F.col("k") == "web_search_call") & F.col("call_id").isNull(), 1).when((F.col("k") == "web_search_end") & F.col("call_id").isNotNull(), -1)
    height = F.sum(step).over(Window.partitionBy("doc", "action").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("edge", F.when(step == 1, height).when(step == -1, height + 1))
    rows = rows.withColumn("nth", F.when(F.col("edge").isNotNull(), F.row_number().over(Window.partitionBy("doc", "k", "action", "edge").orderBy("line_no"))))
    ends = rows.where("k = 'web_search_end' and call_id is not null").select("doc", "action", "edge", "nth", F.col("call_id").alias("end_id"))
    rows = rows.join(ends, ["doc", "action", "edge", "nth"], "left")
    rows = rows.withColumn("call_id", F.when(F.col("k") == "web_search_call", F.coalesce("call_id", "end_id", F.concat(F.lit("web_search:"), "line_no"))).otherwise(F.col("call_id")))
    so_far = Window.partitionBy("doc", "call_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("occurrence", F.coalesce(F.max(F.when(F.col("k").isin("function_call", "custom_tool_call"), F.col("line_no"))).over(so_far), F.lit(-1)))

    said = rows.where((_V("k") == "message") & J.text_at(_V("p"), "$.role").isin("user", "assistant")).withColumn("role", J.text_at(_V("p"), "$.role"))
    parts = F.coalesce(J.array_at(_V("p"), "$.content"), F.array().cast("array<variant>"))
    starts = lambda t: t.rlike(r"^\s*(" + "|".join(SETUP) + ")")
    setup = (F.size(parts) > 0) & F.forall(parts, lambda x: F.coalesce(J.text_at(x, "$.type").isin("input_text", "output_text") & starts(J.text_at(x, "$.text")), F.lit(False)))
    said = said.where((F.col("role") == "assistant") | ~setup)
    texts = said.select("doc", "line_no", "ts", "role", F.posexplode(parts).alias("j", "b"))
    image = J.text_at(_V("b"), "$.type") == "input_image"
    texts = texts.select("doc", "line_no", "ts", "role", "j", F.when(image, "image").otherwise("text").alias("type"), F.when(~image, J.text_at(_V("b"), "$.text")).alias("text"), J.text_at(_V("b"), "$.type").alias("native"), J.data_url(J.text_at(_V("b"), "$.image_url")).alias("image"))
    texts = texts.where("(native in ('input_text', 'output_text') and text <> '') or (type = 'image' and image is not null)").drop("native", "image")

    base = ["doc", "line_no", "ts"]
    summary = F.filter(F.coalesce(J.array_at(_V("p"), "$.summary"), F.array().cast("array<variant>")), lambda x: F.coalesce(J.text_at(x, "$.type") == "summary_text", F.lit(False)))
    thinking = rows.where((_V("k") == "reasoning") & (F.size(summary) > 0)).select(*base, F.lit("assistant").alias("role"), F.lit(0).alias("j"), F.lit("thinking").alias("type"), F.array_join(F.transform(summary, lambda x: J.text_at(x, "$.text")), "\n\n").alias("text"))
    calls = rows.where("k in ('function_call', 'custom_tool_call', 'web_search_call') and call_id is not null")
    name = F.when(F.col("k") == "web_search_call", "WebSearch").otherwise(F.coalesce(J.text_at(_V("p"), "$.name"), F.when(F.col("k") == "function_call", "tool").otherwise("custom_tool")))
    written = F.coalesce(J.text_at(_V("p"), "$.arguments"), J.text_at(_V("p"), "$.input"))
    raw = F.when(F.col("k") == "web_search_call", F.col("action")).otherwise(F.coalesce(F.to_json(J.parse(written)), F.when(written.isNotNull(), F.to_json(F.struct(written.alias("input")))), J.json_at(_V("p"), "$.input"), F.lit("{}")))
    shell = name.isin("exec_command", "shell") & shell_command(raw).isNotNull()
    calls = calls.select(*base, F.lit("assistant").alias("role"), F.lit(0).alias("j"), F.lit("tool_use").alias("type"), F.col("call_id").alias("tool_id"), F.when(shell, "Bash").otherwise(name).alias("tool_name"), F.when(shell, F.to_json(F.struct(shell_command(raw).alias("command")))).otherwise(raw).alias("tool_input_json"))

    both = F.concat_ws("\n", F.nullif(J.text_at(_V("p"), "$.stdout"), F.lit("")), F.nullif(J.text_at(_V("p"), "$.stderr"), F.lit("")))
    output = J.text_at(_V("p"), "$.output")
    inner = J.parse(output)
    custom_text, custom_json = J.text_at(inner, "$.output"), J.json_at(inner, "$.output")
    body = F.when(F.col("k") == "exec_command_end", F.coalesce(J.text_at(_V("p"), "$.aggregated_output"), both)).when(F.col("k") == "web_search_end", F.coalesce(J.text_at(_V("p"), "$.query"), F.lit(""))).when(F.col("k") == "custom_tool_call_output", F.coalesce(custom_text, F.when(custom_json.isNull(), F.coalesce(output, F.lit(""))))).otherwise(F.coalesce(output, F.lit("")))
    code = F.coalesce(J.long_at(_V("p"), "$.exit_code"), J.long_at(inner, "$.metadata.exit_code"))
    results = rows.where("k in ('exec_command_end', 'web_search_end', 'custom_tool_call_output', 'function_call_output') and call_id is not null")
    canonical = results.where("k <> 'function_call_output'").select("doc", "call_id", "occurrence").distinct()
    fallback = results.where("k = 'function_call_output'").join(canonical, ["doc", "call_id", "occurrence"], "left_anti")
    results = results.where("k <> 'function_call_output'").unionByName(fallback)
    results = results.select(*base, F.lit("user").alias("role"), F.lit(0).alias("j"), F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_id"), body.alias("result_text"), F.when(body.isNull(), custom_json).alias("result_json"), F.coalesce((code != 0) & F.col("k").isin("exec_command_end", "custom_tool_call_output"), F.lit(False)).alias("is_error"))
    every = texts
    for more in (thinking, calls, results):
        every = every.unionByName(more, allowMissingColumns=True)
    every = every.withColumn("is_error", F.coalesce("is_error", F.lit(False)))
    out = c.sessions(meta, harness=F.lit("codex"), id=_V("id"), source=F.lit(None), ts=_V("ts"), cwd=_V("cwd"), branch=_V("branch"), cli_version=_V("cli_version"), model=F.coalesce("model", "turn_model"), seq=F.xxhash64("doc"))
    return Sessions(out, block_table(number_messages(every, ["line_no"], "j")))


@adapter("cursor")
def cursor(sessions: DataFrame, blobs: DataFrame) -> Sessions:
    """Exported tables: sessions(id, title, cwd, model, created_at in milliseconds) and blobs(session_id, rowid, data as text
    or binary).  Blobs that aren't JSON are left out, as are injected contexts (<user_info>); <user_query> wrappers go."""
    s = sessions.withColumn("doc", c.doc_key(F.lit("cursor"), _V("id")))
    meta = c.sessions(s, harness=F.lit("cursor"), id=_V("id"), source=F.lit(None), ts=F.timestamp_millis("created_at"), title=_V("title"), cwd=_V("cwd"), model=_V("model"), seq=F.xxhash64("doc"))
    rows = s.select(F.col("id").alias("session_id"), "doc", F.timestamp_millis("created_at").alias("ts")).join(blobs, "session_id")
    rows = rows.withColumn("v", J.parse(F.col("data").cast("string"))).withColumn("who", J.text_at(_V("v"), "$.role")).where("who in ('user', 'assistant', 'tool')")
    b = rows.select("doc", "rowid", "ts", "who", F.posexplode(_content(_V("v"), "$.content")).alias("j", "b"))
    kind = J.text_at(_V("b"), "$.type")
    plain = F.regexp_replace(F.regexp_replace(J.text_at(_V("b"), "$.text"), r"(?s)^\s*<user_query>\s*(.*?)\s*</user_query>\s*$", "$1"), r"\[REDACTED\]", "")
    name, given = J.text_at(_V("b"), "$.toolName"), F.coalesce(J.json_at(_V("b"), "$.args"), F.lit("{}"))
    own = F.when(kind == "tool-call", "tool_use").when(kind == "tool-result", "tool_result").when(kind.isin("reasoning", "thinking"), "thinking").when(kind == "text", "text")
    b = b.select(
        "doc", "rowid", "ts", "j", F.when(F.col("who") == "assistant", "assistant").otherwise("user").alias("role"), "who", own.alias("type"),
        F.when(kind == "text", plain).when(own == "thinking", F.coalesce(J.text_at(_V("b"), "$.text"), J.text_at(_V("b"), "$.thinking"), F.lit(""))).alias("text"),
        J.text_at(_V("b"), "$.toolCallId").alias("tool_id"), F.when(own == "tool_use", name).alias("tool_name"), F.when(own == "tool_use", given).alias("tool_input_json"),
        F.when(own == "tool_result", F.when(F.try_variant_get("b", "$.result", "variant").isNull(), "").otherwise(J.text_at(_V("b"), "$.result"))).alias("result_text"),
        F.when((own == "tool_result") & ~J.is_string(_V("b"), "$.result"), J.json_at(_V("b"), "$.result")).alias("result_json"),
        J.bool_at(_V("b"), "$.isError").alias("is_error"),
    )
    b = _whole(b.where("(who = 'tool') = (type = 'tool_result')")).where("type <> 'text' or (text <> '' and not (who = 'user' and ltrim(text) like '<user_info>%'))")
    return Sessions(meta, block_table(number_messages(b, ["rowid"], "j")))


@adapter("cursor_desktop")
def cursor_desktop(headers: DataFrame, kv: DataFrame) -> Sessions:
    """Exported tables: headers(id, name, created_at in milliseconds) and kv(key, value) with composerData:<id> and
    bubbleId:<id>:<bubble>.  Bubbles come in the order of the session's recorded list, each once; without one, by key.  The
    assistant's bubbles up to a call are one message; the call's result is the user's."""
    s = headers.withColumn("doc", c.doc_key(F.lit("cursor_desktop"), _V("id")))
    meta = c.sessions(s, harness=F.lit("cursor_desktop"), id=_V("id"), source=F.lit(None), ts=F.timestamp_millis("created_at"), title=_V("name"), seq=F.xxhash64("doc"))
    ids = s.select("id", "doc", F.timestamp_millis("created_at").alias("ts"))
    bubbles = kv.where(F.col("key").startswith("bubbleId:")).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("id"), "key", J.parse(_V("value")).alias("v")).where("v is not null").join(ids, "id")
    bubbles = bubbles.withColumn("bubble", F.coalesce(J.text_at(_V("v"), "$.bubbleId"), F.split_part("key", F.lit(":"), F.lit(3))))
    lists = kv.where(F.col("key").startswith("composerData:")).select(F.split_part("key", F.lit(":"), F.lit(2)).alias("id"), J.array_at(J.parse(_V("value")), "$.fullConversationHeadersOnly").alias("h")).where("size(h) > 0")
    places = lists.select("id", F.posexplode("h").alias("at", "x")).select("id", J.text_at(_V("x"), "$.bubbleId").alias("bubble"), "at").groupBy("id", "bubble").agg(F.min("at").alias("at"))
    listed = lists.select("id", F.lit(True).alias("listed"))
    rows = bubbles.join(listed, "id", "left").join(places, ["id", "bubble"], "left").where("listed is null or at is not null")
    rows = rows.withColumn("ord", F.struct(F.coalesce("at", F.lit(0)).alias("a"), "key")).withColumn("t", J.long_at(_V("v"), "$.type")).where("t in (1, 2)")
    call, name = "$.toolFormerData", J.text_at(_V("v"), "$.toolFormerData.name")
    order = Window.partitionBy("doc").orderBy("ord")
    # A user's bubble, and what follows a call, starts a new message.
    before = F.coalesce(F.lag(F.struct("t", name.isNotNull().alias("call"))).over(order), F.struct(F.lit(1).cast("bigint").alias("t"), F.lit(False).alias("call")))
    rows = rows.withColumn("new", ((F.col("t") == 1) | (before["t"] == 1) | before["call"]).cast("int")).withColumn("turn", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = ["doc", "turn", "ts", "ord"]
    user = rows.where("t = 1").select(*base, F.lit(0).alias("sub"), F.lit(0).alias("part"), F.lit("user").alias("role"), F.lit("text").alias("type"), J.text_at(_V("v"), "$.text").alias("text"))
    mine = rows.where("t = 2")
    thinking = mine.select(*base, F.lit(0).alias("sub"), F.lit(0).alias("part"), F.lit("assistant").alias("role"), F.lit("thinking").alias("type"), J.text_at(_V("v"), "$.thinking.text").alias("text"))
    texts = mine.select(*base, F.lit(0).alias("sub"), F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.lit("text").alias("type"), J.text_at(_V("v"), "$.text").alias("text"))
    spoken = user.unionByName(thinking).unionByName(texts).where("trim(text) <> ''")
    called = mine.where(name.isNotNull()).withColumn("cid", F.coalesce(F.nullif(F.regexp_replace(J.text_at(_V("v"), f"{call}.toolCallId"), "[^A-Za-z0-9_-]", "_"), F.lit("")), F.concat(F.lit("call_"), F.col("ord")["key"])))
    uses = called.select(*base, F.lit(0).alias("sub"), F.lit(2).alias("part"), F.lit("assistant").alias("role"), F.lit("tool_use").alias("type"), F.col("cid").alias("tool_id"), name.alias("tool_name"), F.coalesce(F.to_json(J.parse(J.text_at(_V("v"), f"{call}.params"))), F.lit("{}")).alias("tool_input_json"))
    status = J.text_at(_V("v"), f"{call}.status")
    results = called.where(status.isin("completed", "error")).select(*base, F.lit(1).alias("sub"), F.lit(0).alias("part"), F.lit("user").alias("role"), F.lit("tool_result").alias("type"), F.col("cid").alias("tool_id"), F.coalesce(J.text_at(_V("v"), f"{call}.result"), F.lit("")).alias("result_text"), (status == "error").alias("is_error"))
    every = spoken.unionByName(uses, allowMissingColumns=True).unionByName(results, allowMissingColumns=True).withColumn("is_error", F.coalesce("is_error", F.lit(False)))
    every = every.withColumn("inner", F.struct("ord", "part"))
    return Sessions(meta, block_table(number_messages(every, ["turn", "sub"], "inner")))


@adapter("grok_bot")
def grok_bot(lines: DataFrame) -> Sessions:
    """JSON lines {role, message: {content: [...]}}.  A result without an id answers the first open call of its tool's name,
    else the oldest open call."""
    v = _V("v")
    meta = lines.groupBy("file", "stem").agg(F.min(J.timestamp(J.text_at(v, "$.timestamp"))).alias("ts")).withColumn("doc", c.doc_key(F.lit("grok_bot"), _V("stem")))
    rows = lines.join(meta.select("file", "doc", "ts"), "file").withColumn("who", J.text_at(v, "$.role")).where("who in ('user', 'assistant', 'tool')")
    b = rows.select("doc", "line_no", "ts", "who", F.posexplode(_content(v, "$.message.content")).alias("j", "b"))
    kind = J.text_at(_V("b"), "$.type")
    own = F.when(kind.isin("tool_use", "tool-call", "tool_call"), "tool_use").when(kind.isin("tool_result", "tool-result"), "tool_result").when(kind.isin("thinking", "reasoning"), "thinking").when(kind == "text", "text")
    b = b.withColumns({"type": own, "name": F.coalesce(J.text_at(_V("b"), "$.name"), F.lit("tool"))}).where("type is not null")
    e = b.where("type in ('tool_use', 'tool_result')").select("doc", "line_no", "j", (F.col("type") == "tool_use").alias("call"), "name", F.when(F.col("type") == "tool_use", F.coalesce(J.text_at(_V("b"), "$.id"), F.concat_ws(":", F.lit("call"), "line_no", "j"))).alias("own"))
    held = e.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line_no", "j", "call", "name", "own"))).alias("e"))
    paired = held.select("doc", F.explode(_by_name(_V("e"))).alias("r")).select("doc", F.col("r.line_no").alias("line_no"), F.col("r.j").alias("j"), F.col("r.tool_id").alias("tool_id"))
    b = b.join(paired, ["doc", "line_no", "j"], "left")
    failed = F.try_variant_get("b", "$.result.failure", "variant").isNotNull()
    out = b.select(
        "doc", "line_no", "ts", "j", F.when(F.col("who") == "assistant", "assistant").otherwise("user").alias("role"), "type",
        F.when(F.col("type").isin("text", "thinking"), J.text_at(_V("b"), "$.text")).alias("text"), "tool_id",
        F.when(F.col("type") == "tool_use", F.col("name")).alias("tool_name"), F.when(F.col("type") == "tool_use", F.coalesce(J.json_at(_V("b"), "$.input"), J.json_at(_V("b"), "$.args"), F.lit("{}"))).alias("tool_input_json"),
        F.when(F.col("type") == "tool_result", J.text_at(_V("b"), "$.result")).alias("result_text"),
        F.when((F.col("type") == "tool_result") & ~J.is_string(_V("b"), "$.result"), F.coalesce(J.json_at(_V("b"), "$.result"), F.lit("null"))).alias("result_json"),
        (failed & (F.col("type") == "tool_result")).alias("is_error"),
    )
    sess = c.sessions(meta, harness=F.lit("grok_bot"), id=_V("stem"), source=F.lit(None), ts=_V("ts"), seq=F.xxhash64("doc"))
    return Sessions(sess, block_table(number_messages(_whole(out), ["line_no"], "j")))


def _by_name(events: Column) -> Column:
    """Ids of calls and results (line_no, j, call, name, own), in order: a queue of a session's open calls, asked by name."""
    zero = F.struct(F.array().cast("array<struct<id:string,name:string>>").alias("open"), F.array().cast("array<struct<line_no:int,j:int,tool_id:string>>").alias("out"))

    def step(a, x):
        names = F.transform(a["open"], lambda q: q["name"])
        at = F.greatest(F.array_position(names, x["name"]), F.lit(1)).cast("int")
        found = F.get(a["open"], at - 1)["id"]
        rest = F.concat(F.slice(a["open"], F.lit(1), at - 1), F.slice(a["open"], at + 1, F.greatest(F.size(a["open"]), F.lit(1))))
        queue = F.when(x["call"], F.array_append(a["open"], F.struct(x["own"].alias("id"), x["name"].alias("name")))).otherwise(rest)
        own = F.when(x["call"], x["own"]).otherwise(F.coalesce(found, F.concat(F.lit("orphan:"), x["name"])))
        return F.struct(queue.alias("open"), F.array_append(a["out"], F.struct(x["line_no"].cast("int").alias("line_no"), x["j"].cast("int").alias("j"), own.alias("tool_id"))).alias("out"))

    return F.aggregate(events, zero, step)["out"]

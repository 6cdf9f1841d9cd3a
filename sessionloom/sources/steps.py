"""Adapters of step logs: two logs aligned by ordinal, committed turns, protobuf steps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans import canonical as c
from .base import Sessions, adapter, block_table, number_messages

_V = F.col


def aligned(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Left rows with the right row of the same ordinal within keys, or nulls: the k-th with the k-th."""
    a = left.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(left_order)))
    b = right.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(right_order))).drop(right_order)
    return a.join(b, [*keys, "nth"], "left").drop("nth")


@adapter("grok")
def grok(chat: DataFrame, updates: DataFrame) -> Sessions:
    """A session's chat lines (file, stem, line_no, v) and update lines, in files of one stem.

    Times come from the updates: the k-th prompt, thought and agent message for the k-th record of its kind, calls and results
    by id; a failed result is an error.  Contexts (<user_info>) are left out."""
    v = _V("v")
    doc = c.doc_key(F.lit("grok"), _V("stem"))
    rows = chat.withColumn("doc", doc).withColumn("k", J.text_at(v, "$.type")).where("k in ('user', 'assistant', 'reasoning', 'tool_result')")
    text = F.coalesce(J.text_at(v, "$.content"), F.array_join(F.transform(F.coalesce(J.array_at(v, "$.content"), F.array().cast("array<variant>")), lambda x: F.coalesce(J.text_at(x, "$.text"), F.lit(""))), "\n"))
    summary = F.array_join(F.transform(F.coalesce(J.array_at(v, "$.summary"), F.array().cast("array<variant>")), lambda x: F.coalesce(J.text_at(x, "$.text"), F.lit(""))), "\n")
    rows = rows.withColumns({"body": F.coalesce(F.when(F.col("k") == "reasoning", summary).otherwise(text), F.lit(""))})
    rows = rows.where("not (k = 'user' and (body like '%<user_info>%' or trim(body) = '')) and not (k = 'reasoning' and trim(body) = '')")
    spoken = (F.col("k") != "assistant") | (F.trim("body") != "")
    u = updates.withColumn("doc", doc).withColumns({"what": J.text_at(v, "$.params.update.sessionUpdate"), "call": J.text_at(v, "$.params.update.toolCallId"), "status": J.text_at(v, "$.params.update.status"), "at": F.coalesce(J.epoch(J.long_at(v, "$.params._meta.agentTimestampMs"), "ms"), J.epoch(J.long_at(v, "$.timestamp")))}).where("at is not null")
    kinds = F.when(F.col("what") == "user_message_chunk", "user").when(F.col("what") == "agent_thought_chunk", "reasoning").when(F.col("what") == "agent_message_chunk", "assistant")
    prompt = F.coalesce(J.long_at(v, "$.params.update._meta.promptIndex"), F.col("line_no").cast("long"))
    chunks = u.withColumn("k", kinds).where("k is not null").withColumn("slot", F.when(F.col("k") == "user", prompt).otherwise(F.col("line_no"))).groupBy("doc", "k", "slot").agg(F.min("at").alias("at"))
    timed = aligned(rows.where(spoken & (F.col("k") != "tool_result")), chunks, ["doc", "k"], "line_no", "slot")
    rest = rows.where(~spoken | (F.col("k") == "tool_result")).withColumn("at", F.lit(None).cast("timestamp"))
    rows = timed.unionByName(rest, allowMissingColumns=True)
    of_call = u.where("what = 'tool_call'").groupBy("doc", "call").agg(F.min("at").alias("call_at"))
    of_result = u.where("what = 'tool_call_update' and status in ('completed', 'failed')").groupBy("doc", "call").agg(F.max_by("at", "line_no").alias("result_at"), F.bool_or(F.col("status") == "failed").alias("failed"))
    start = u.groupBy("doc").agg(F.min("at").alias("ts0"))
    base = ["doc", "line_no"]
    said = rows.where("k in ('user', 'assistant', 'reasoning') and trim(body) <> ''").select(*base, F.when(F.col("k") == "user", "user").otherwise("assistant").alias("role"), F.lit(0).alias("j"), F.when(F.col("k") == "reasoning", "thinking").otherwise("text").alias("type"), F.col("body").alias("text"), "at")
    calls = rows.where("k = 'assistant'").select(*base, F.col("at").alias("own_at"), F.posexplode(J.array_at(v, "$.tool_calls")).alias("i", "b"))
    raw = F.coalesce(F.to_json(J.parse(J.text_at(_V("b"), "$.arguments"))), J.json_at(_V("b"), "$.arguments"), F.lit("{}"))
    calls = calls.select(*base, F.lit("assistant").alias("role"), (F.col("i") + 1).alias("j"), F.lit("tool_use").alias("type"), J.text_at(_V("b"), "$.id").alias("tool_id"), F.coalesce(J.text_at(_V("b"), "$.name"), F.lit("tool")).alias("tool_name"), raw.alias("tool_input_json"), "own_at").where("tool_id is not null")
    calls = calls.join(of_call.withColumnRenamed("call", "tool_id"), ["doc", "tool_id"], "left").withColumn("at", F.coalesce("own_at", "call_at")).drop("own_at", "call_at")
    results = rows.where("k = 'tool_result'").select(*base, F.lit("user").alias("role"), F.lit(0).alias("j"), F.lit("tool_result").alias("type"), J.text_at(v, "$.tool_call_id").alias("tool_id"), F.when(F.try_variant_get(v, "$.content", "variant").isNull(), "").otherwise(J.text_at(v, "$.content")).alias("result_text"), F.when(~J.is_string(v, "$.content"), J.json_at(v, "$.content")).alias("result_json"))
    results = results.join(of_result.withColumnRenamed("call", "tool_id"), ["doc", "tool_id"], "left").withColumn("is_error", F.coalesce("failed", F.lit(False))).withColumnRenamed("result_at", "at").drop("failed")
    every = said.unionByName(calls, allowMissingColumns=True).unionByName(results, allowMissingColumns=True).join(start, "doc", "left")
    every = every.withColumns({"ts": F.coalesce("at", "ts0"), "is_error": F.coalesce("is_error", F.lit(False))})
    meta = chat.select("stem").distinct().withColumn("doc", doc).join(start, "doc", "left")
    sess = c.sessions(meta, harness=F.lit("grok"), id=_V("stem"), source=F.lit(None), ts=_V("ts0"), seq=F.xxhash64("doc"))
    return Sessions(sess, block_table(number_messages(every, ["line_no"], "j")))


@adapter("fx")
def fx(docs: DataFrame) -> Sessions:
    """JSON bundles {session: {id, title, cwd, model}, events: [...]}: committed turns become a prompt, steps with their calls
    and results, and a last text; an interrupted turn has a text and a call at most."""
    v = _V("v")
    rows = docs.withColumn("id", F.coalesce(J.text_at(v, "$.session.id"), J.text_at(v, "$.id"), "stem")).withColumn("doc", c.doc_key(F.lit("fx"), _V("id")))
    e = rows.select("doc", F.posexplode(J.array_at(v, "$.events")).alias("i", "e")).where(J.text_at(_V("e"), "$.kind") == "history_turn_committed")
    e = e.select("doc", "i", J.epoch(J.long_at(_V("e"), "$.timestamp_ms"), "ms").alias("ts"), F.try_variant_get("e", "$.payload.turn", "variant").alias("t")).where("t is not null")
    meta = rows.join(e.groupBy("doc").agg(F.min("ts").alias("ts")), "doc", "left")
    meta = c.sessions(meta, harness=F.lit("fx"), id=_V("id"), source=F.lit(None), ts=_V("ts"), title=J.text_at(v, "$.session.title"), cwd=J.text_at(v, "$.session.cwd"), model=J.text_at(v, "$.session.model"), seq=F.xxhash64("doc"))
    t, cut = _V("t"), F.coalesce(J.text_at(_V("t"), "$.kind") == "interrupted", F.lit(False))
    last = 1 << 20
    key = lambda step, sub, j: [F.lit(step).alias("step") if isinstance(step, int) else step.alias("step"), F.lit(sub).alias("sub"), F.lit(j).alias("j") if isinstance(j, int) else j.alias("j")]
    words = lambda text, role, step, sub: [*key(step, sub, 0), F.lit(role).alias("role"), F.lit("text").alias("type"), text.alias("text")]
    user = e.select("doc", "i", "ts", *words(J.text_at(t, "$.user.text"), "user", -1, 0))
    final = e.select("doc", "i", "ts", *words(J.text_at(t, "$.assistant"), "assistant", last, 0))
    steps = e.where(~cut).select("doc", "i", "ts", F.posexplode(J.array_at(t, "$.execution.tool_steps")).alias("step", "s"))
    between = steps.select("doc", "i", "ts", *words(J.text_at(_V("s"), "$.assistant"), "assistant", F.col("step"), 0))
    texts = user.unionByName(between).unionByName(final).where("trim(text) <> ''")
    raw = lambda b: F.coalesce(F.to_json(J.parse(J.text_at(b, "$.arguments_json"))), J.json_at(b, "$.arguments_json"), F.lit("{}"))
    use = lambda b: [F.lit("assistant").alias("role"), F.lit("tool_use").alias("type"), J.text_at(b, "$.id").alias("tool_id"), F.coalesce(J.text_at(b, "$.name"), F.lit("tool")).alias("tool_name"), raw(b).alias("tool_input_json")]
    calls = steps.select("doc", "i", "ts", "step", F.posexplode(J.array_at(_V("s"), "$.tool_calls")).alias("n", "b")).select("doc", "i", "ts", *key(F.col("step"), 0, F.col("n") + 1), *use(_V("b")))
    broken = e.where(cut & F.try_variant_get("t", "$.tool_call.id", "string").isNotNull()).withColumn("b", F.try_variant_get("t", "$.tool_call", "variant")).select("doc", "i", "ts", *key(last, 0, 1), *use(_V("b")))
    results = steps.select("doc", "i", "ts", "step", F.posexplode(J.array_at(_V("s"), "$.tool_results")).alias("n", "b"))
    results = results.select("doc", "i", "ts", *key(F.col("step"), 1, F.col("n")), F.lit("user").alias("role"), F.lit("tool_result").alias("type"), J.text_at(_V("b"), "$.tool_call_id").alias("tool_id"), F.when(F.try_variant_get("b", "$.output", "variant").isNull(), "").otherwise(J.text_at(_V("b"), "$.output")).alias("result_text"), F.when(~J.is_string(_V("b"), "$.output"), J.json_at(_V("b"), "$.output")).alias("result_json"), F.coalesce(J.text_at(_V("b"), "$.status") == "failure", F.lit(False)).alias("is_error"))
    every = texts
    for more in (calls, broken, results):
        every = every.unionByName(more.where("tool_id is not null"), allowMissingColumns=True)
    every = every.withColumn("is_error", F.coalesce("is_error", F.lit(False)))
    return Sessions(meta, block_table(number_messages(every, ["i", "step", "sub"], "j")))


# ── protobuf ───────────────────────────────────────────────────────────
def varint(buf: bytes, at: int) -> tuple[int, int] | None:
    """A number and where it ends."""
    value = shift = 0
    while at < len(buf) and shift < 64:
        value |= (buf[at] & 0x7F) << shift
        at += 1
        if not buf[at - 1] & 0x80:
            return value, at
        shift += 7
    return None


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields, as far as it can be read; groups and broken ends stop it."""
    at = 0
    while at < len(buf):
        tag = varint(buf, at)
        if tag is None or not tag[0] >> 3:
            return
        number, kind, at = tag[0] >> 3, tag[0] & 7, tag[1]
        if kind in (0, 2):
            got = varint(buf, at)
            if got is None:
                return
            value, at = got
            if kind == 2:
                if at + value > len(buf):
                    return
                value, at = buf[at : at + value], at + value
        elif kind in (1, 5):
            width = 8 if kind == 1 else 4
            if at + width > len(buf):
                return
            value, at = buf[at : at + width], at + width
        else:
            return
        yield number, value


class Message(dict):
    """A message's fields by number, each a list."""

    def __init__(self, buf: bytes | None):
        super().__init__()
        for number, value in fields(bytes(buf or b"")):
            self.setdefault(number, []).append(value)

    def parts(self, number: int) -> list[bytes]:
        return [x for x in self.get(number, []) if isinstance(x, bytes)]

    def part(self, number: int) -> Message:
        return Message(next(iter(self.parts(number)), b""))

    def text(self, number: int) -> str | None:
        try:
            return next((x.decode() for x in self.parts(number)), None)
        except UnicodeDecodeError:
            return None

    def number(self, number: int) -> int | None:
        return next((x for x in self.get(number, []) if isinstance(x, int)), None)


#: Step types by number, those without conversation, finished states, and fields of a step's payload.
USER_INPUT, PLANNER = 14, 15
SILENT = {23, 90, 98, 101}
DONE, ERROR, CANCELED = 3, 7, 6
META, USER, PLAN = 5, 19, 20
_STEP = "array<struct<role:string,type:string,text:string,tool_id:string,tool_name:string,tool_input_json:string,result_text:string,is_error:boolean,seconds:double>>"


def step_blocks(kind: int, status: int, payload: bytes, error: bytes) -> list[dict]:
    """Blocks of one step."""
    body = Message(payload)
    meta = body.part(META)
    stamp = meta.part(1)
    seconds = None if stamp.number(1) is None else stamp.number(1) + (stamp.number(2) or 0) / 1e9
    row = lambda **d: {"role": "assistant", "type": "text", "text": None, "tool_id": None, "tool_name": None, "tool_input_json": None, "result_text": None, "is_error": False, "seconds": seconds, **d}
    filled = lambda x: x if x and x.strip() else None
    if kind in SILENT:
        return []
    if kind == USER_INPUT:
        asked = body.part(USER)
        text = filled(asked.text(2)) or next((x for x in (filled(Message(p).text(1)) for p in asked.parts(3)) if x), None) or filled(asked.text(1))
        return [row(role="user", text=text)] if text else []
    if kind == PLANNER:
        plan, out = body.part(PLAN), []
        if filled(plan.text(3)):
            out.append(row(type="thinking", text=plan.text(3)))
        if filled(plan.text(1)):
            out.append(row(text=plan.text(1)))
        for raw in plan.parts(7):
            call = Message(raw)
            if call.text(1) is not None and call.text(2) is not None:
                try:
                    given = json.loads(call.text(3) or "{}")
                except ValueError:
                    given = {}
                out.append(row(type="tool_use", tool_id=call.text(1), tool_name=call.text(2), tool_input_json=json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
        return out
    tool = meta.part(4).text(1)
    if tool is None or status not in (DONE, ERROR, CANCELED):
        return []
    why = Message(error)
    failed = next((x for x in map(filled, (why.text(9), why.text(1), why.text(2))) if x), None)
    texts = [t for number in sorted(body) if number != META for raw in body.parts(number) for t in _texts(raw)]
    return [row(role="user", type="tool_result", tool_id=tool, result_text=failed if failed is not None else "\n".join(texts), is_error=failed is not None or status in (ERROR, CANCELED))]


def _texts(buf: bytes, depth: int = 0) -> list[str]:
    """Readable texts of a message whose schema isn't published, in order."""
    out = []
    for _, value in fields(buf):
        if not isinstance(value, bytes) or not value:
            continue
        inner = list(fields(value)) if depth < 4 else []
        try:
            text = value.decode()
        except UnicodeDecodeError:
            text = None
        if text is not None and all(ch.isprintable() or ch in "\n\t\r" for ch in text):
            out.append(text)
        elif inner:
            out += _texts(value, depth + 1)
    return out


@adapter("antigravity")
def antigravity(sessions: DataFrame, steps: DataFrame) -> Sessions:
    """Exported tables: sessions(id, title, cwd, created_at in milliseconds) and steps(session_id, idx, step_type, status,
    step_payload, error_details), the last two protobuf.  A step is decoded in Arrow batches; what can't be read is left out."""

    @F.pandas_udf(_STEP)
    def decode(kind: pd.Series, status: pd.Series, payload: pd.Series, error: pd.Series) -> pd.Series:
        return pd.Series([step_blocks(int(k), int(s), p, e) for k, s, p, e in zip(kind, status, payload, error, strict=True)])

    s = sessions.withColumn("doc", c.doc_key(F.lit("antigravity"), _V("id")))
    meta = c.sessions(s, harness=F.lit("antigravity"), id=_V("id"), source=F.lit(None), ts=F.timestamp_millis("created_at"), title=_V("title"), cwd=_V("cwd"), seq=F.xxhash64("doc"))
    rows = s.select(F.col("id").alias("session_id"), "doc", F.timestamp_millis("created_at").alias("ts0")).join(steps, "session_id")
    b = rows.select("doc", "idx", "ts0", F.posexplode(decode("step_type", F.coalesce("status", F.lit(0)), "step_payload", "error_details")).alias("j", "b")).select("doc", "idx", "j", "ts0", "b.*")
    b = b.withColumn("ts", F.coalesce(J.epoch(_V("seconds")), "ts0"))
    return Sessions(meta, block_table(number_messages(b, ["idx"], "j")))

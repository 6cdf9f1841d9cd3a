"""Adapters of message trees: the path from the root to the current leaf, or all messages where that path is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans import canonical as c
from .base import Sessions, active_path, adapter, block_table, carried, number_messages
from .transcripts import _blocks, _content, _whole

_V = F.col


def _ordered(nodes: DataFrame, leaves: DataFrame, fallback: list[str]) -> DataFrame:
    """nodes (doc, node, parent, ...) with pos: along the active path, else in fallback order."""
    path = active_path(nodes.select("doc", "node", "parent"), leaves).withColumnRenamed("pos", "p")
    whole = path.select("doc").distinct().withColumn("walked", F.lit(True))
    rows = nodes.join(whole, "doc", "left").join(path, ["doc", "node"], "left").where("walked is null or p is not null")
    return rows.withColumn("ord", F.struct(F.coalesce("p", F.lit(0)).alias("p"), *fallback)).drop("p", "walked")


@adapter("chatgpt")
def chatgpt(docs: DataFrame) -> Sessions:
    """Offline documents {id or conversation_id, title, create_time, current_node, mapping: {id: {id, parent, message}}}.

    Without a whole path to current_node, all messages by time (none: first) and id.  Hidden messages are left out, but for
    tools' results; a message to a tool is a call."""
    v = _V("v")
    rows = docs.withColumn("id", F.coalesce(J.text_at(v, "$.conversation_id"), J.text_at(v, "$.id"), "stem")).withColumn("doc", c.doc_key(F.lit("chatgpt"), _V("id")))
    rows = rows.withColumn("ts0", J.epoch(F.try_variant_get(v, "$.create_time", "double")))
    meta = c.sessions(rows, harness=F.lit("chatgpt"), id=_V("id"), source=F.lit(None), ts=_V("ts0"), title=J.text_at(v, "$.title"), seq=F.xxhash64("doc"))
    mapping = F.try_variant_get(v, "$.mapping", "map<string,variant>")
    nodes = rows.select("doc", "ts0", F.explode(mapping).alias("node", "n")).withColumns({"parent": J.text_at(_V("n"), "$.parent"), "time": F.try_variant_get(_V("n"), "$.message.create_time", "double")})
    leaves = rows.select("doc", J.text_at(v, "$.current_node").alias("leaf")).where("leaf <> ''")
    m = _ordered(nodes.withColumn("t", F.coalesce("time", F.lit(float("-inf")))), leaves, ["t", "node"])
    m = m.withColumns({"m": F.try_variant_get("n", "$.message", "variant")}).withColumn("who", J.text_at(_V("m"), "$.author.role")).where("who in ('user', 'assistant', 'tool')")
    m = m.where((F.col("who") == "tool") | ~J.bool_at(_V("m"), "$.metadata.is_visually_hidden_from_conversation"))
    m = m.withColumn("ts", F.coalesce(carried(J.epoch(_V("time")), ["ord"]), "ts0"))
    parts = F.coalesce(J.array_at(_V("m"), "$.content.parts"), F.array().cast("array<variant>"))
    text = F.coalesce(F.nullif(F.array_join(F.filter(F.transform(parts, lambda p: J.text_at(p, "$")), lambda p: p.isNotNull()), "\n"), F.lit("")), J.text_at(_V("m"), "$.content.text"), J.text_at(_V("m"), "$.content.content"))
    recipient = J.text_at(_V("m"), "$.recipient")
    call = (F.col("who") == "assistant") & F.coalesce(~recipient.isin("all", "assistant"), F.lit(False))
    think = (F.col("who") == "assistant") & (F.coalesce(J.text_at(_V("m"), "$.content.content_type").isin("thoughts", "reasoning_recap"), F.lit(False)) | F.coalesce(J.text_at(_V("m"), "$.metadata.channel") == "commentary", F.lit(False)) | J.bool_at(_V("m"), "$.metadata.is_reasoning"))
    m = m.withColumns({"body": F.coalesce(text, F.lit("")), "call": call, "mid": F.coalesce(J.text_at(_V("m"), "$.id"), "node")})
    last_call = F.last(F.when(F.col("call"), F.col("mid")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("type", F.when(F.col("who") == "tool", "tool_result").when(call, "tool_use").when(think, "thinking").otherwise("text")).withColumn("last_call", last_call)
    b = m.where("type in ('tool_use', 'tool_result') or body <> ''").select(
        "doc", "ord", "ts", F.when(F.col("who") == "assistant", "assistant").otherwise("user").alias("role"), "type", F.lit(0).alias("j"),
        F.when(F.col("type").isin("text", "thinking"), F.col("body")).alias("text"),
        F.when(F.col("type") == "tool_use", F.col("mid")).when(F.col("type") == "tool_result", F.coalesce("last_call", "mid")).alias("tool_id"),
        F.when(F.col("type") == "tool_use", recipient).alias("tool_name"),
        F.when(F.col("type") == "tool_use", F.coalesce(F.to_json(J.parse(_V("body"))), F.to_json(F.struct(F.col("body").alias("text"))))).alias("tool_input_json"),
        F.when(F.col("type") == "tool_result", F.col("body")).alias("result_text"),
        J.bool_at(_V("m"), "$.metadata.is_error").alias("is_error"),
    )
    return Sessions(meta, block_table(number_messages(b, ["ord"], "j")))


@adapter("claude_chat")
def claude_chat(docs: DataFrame) -> Sessions:
    """Offline documents {uuid, name, created_at, model, current_leaf_message_uuid, chat_messages: [...]}.

    Without a whole path to the current leaf, all messages in the server's order."""
    v = _V("v")
    rows = docs.withColumn("id", F.coalesce(J.text_at(v, "$.uuid"), "stem")).withColumn("doc", c.doc_key(F.lit("claude_chat"), _V("id")))
    rows = rows.withColumn("ts0", J.timestamp(J.text_at(v, "$.created_at")))
    meta = c.sessions(rows, harness=F.lit("claude_chat"), id=_V("id"), source=F.lit(None), ts=_V("ts0"), title=J.text_at(v, "$.name"), model=J.text_at(v, "$.model"), seq=F.xxhash64("doc"))
    nodes = rows.select("doc", "ts0", F.posexplode(J.array_at(v, "$.chat_messages")).alias("i", "m"))
    nodes = nodes.withColumns({"node": F.coalesce(J.text_at(_V("m"), "$.uuid"), F.concat(F.lit("#"), "i")), "parent": J.text_at(_V("m"), "$.parent_message_uuid")})
    leaves = rows.select("doc", J.text_at(v, "$.current_leaf_message_uuid").alias("leaf")).where("leaf <> ''")
    m = _ordered(nodes, leaves, ["i"])
    sender = J.text_at(_V("m"), "$.sender")
    m = m.withColumn("role", F.when(sender.isin("human", "user"), "user").when(sender == "assistant", "assistant")).where("role is not null")
    m = m.withColumn("ts", F.coalesce(carried(J.timestamp(J.text_at(_V("m"), "$.created_at")), ["ord"]), "ts0"))
    b = m.select("doc", "ord", "role", "ts", F.posexplode(_content(_V("m"), "$.content")).alias("j", "b"))
    b = _whole(b.select("doc", "ord", "role", "ts", "j", *[x.alias(k) for k, x in _blocks(_V("b")).items()]))
    b = b.withColumn("role", F.when(F.col("type") == "tool_result", "user").otherwise(F.col("role"))).where("type <> 'text' or trim(text) <> ''")
    known = b.where("type = 'text'").groupBy("doc", "ord").agg(F.collect_set(F.trim("text")).alias("known"))
    plain = m.select("doc", "ord", "role", "ts", J.text_at(_V("m"), "$.text").alias("text")).where("trim(text) <> ''").join(known, ["doc", "ord"], "left")
    plain = plain.where(F.col("known").isNull() | ~F.array_contains("known", F.trim("text"))).select("doc", "ord", "role", "ts", F.lit("text").alias("type"), "text", F.lit(1 << 20).alias("j"), F.lit(False).alias("is_error"))
    every = b.unionByName(plain, allowMissingColumns=True)
    # Within a native message, each change between the sides starts a message of its own.
    order = Window.partitionBy("doc", "ord").orderBy("j")
    every = every.withColumn("new", F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(0)))
    every = every.withColumn("turn", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return Sessions(meta, block_table(number_messages(every, ["ord", "turn"], "j")))

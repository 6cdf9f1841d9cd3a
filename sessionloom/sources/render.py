"""Sinks: canonical sessions as native records, with deterministic ids, written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.text import safe_name
from .base import Sessions

_TS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ARTIFACT_BYTES = 64 << 20


def block_json(thinking: str = "thinking") -> Column:
    """A block as JSON text in the widespread form; keys that have nothing are left out."""
    kind = F.col("type")
    result = F.coalesce(F.when(F.col("result_text").isNotNull(), _quoted("result_text")), F.col("result_json"), F.lit('""'))
    return (
        F.when(kind == "text", F.concat(F.lit('{"type":"text","text":'), _quoted("text"), F.lit("}")))
        .when(kind == "thinking", F.concat(F.lit('{"type":"thinking","' + thinking + '":'), _quoted("text"), F.lit("}")))
        .when(kind == "tool_use", F.concat(F.lit('{"type":"tool_use","id":'), _quoted("tool_id"), F.lit(',"name":'), _quoted("tool_name"), F.lit(',"input":'), F.coalesce("tool_input_json", F.lit("{}")), F.lit("}")))
        .when(kind == "tool_result", F.concat(F.lit('{"type":"tool_result","tool_use_id":'), _quoted("tool_id"), F.lit(',"content":'), result, F.when(F.col("is_error"), ',"is_error":true}').otherwise("}")))
    )


def _quoted(name: str) -> Column:
    """A string column as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(F.col(name))), r"(?s)^\[(.*)\]$", "$1")


def _messages(s: Sessions, thinking: str) -> DataFrame:
    """(doc, msg_idx, role, ts, content): content is the one text as a string, else an array of blocks."""
    b = s.blocks.withColumn("json", block_json(thinking)).where("json is not null")
    rows = b.groupBy("doc", "msg_idx").agg(F.first("role").alias("role"), F.first("ts").alias("ts"), F.sort_array(F.collect_list(F.struct("block_idx", "json", "type", F.when(F.col("type") == "text", _quoted("text")).alias("own")))).alias("p"))
    array = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: x["json"]), ","), F.lit("]"))
    one = (F.size("p") == 1) & (F.col("p")[0]["type"] == "text")
    return rows.select("doc", "msg_idx", "role", "ts", F.when(one, F.col("p")[0]["own"]).otherwise(array).alias("content"))


def _pair(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value))


def to_simple(s: Sessions) -> DataFrame:
    """(doc, text): one JSON document for each session."""
    m = _messages(s, "text")
    record = F.concat(F.lit("{"), F.concat_ws(",", _pair("role", F.concat(F.lit('"'), "role", F.lit('"'))), _pair("content", F.col("content")), _pair("timestamp", F.concat(F.lit('"'), F.date_format("ts", _TS), F.lit('"')))), F.lit("}"))
    held = m.select("doc", "msg_idx", record.alias("r")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "r"))).alias("p"))
    rows = s.sessions.join(held, "doc", "left")
    body = F.coalesce(F.array_join(F.transform("p", lambda x: x["r"]), ","), F.lit(""))
    fields = [_pair("id", _quoted("id")), _pair("timestamp", F.concat(F.lit('"'), F.date_format("ts", _TS), F.lit('"')))]
    fields += [F.when(F.col(k).isNotNull(), F.concat(F.lit(f'"{n}":'), _quoted(k))) for k, n in (("cwd", "cwd"), ("branch", "git_branch"), ("title", "title"), ("cli_version", "cli_version"), ("model", "model"))]
    return rows.select("doc", F.concat(F.lit("{"), F.concat_ws(",", *fields, F.concat(F.lit('"messages":['), body, F.lit("]"))), F.lit("}")).alias("text"))


def to_claude_code(s: Sessions) -> DataFrame:
    """(doc, text): JSON lines for each session, each record's uuid made from its place, its parent the one before."""
    m = _messages(s, "thinking").join(s.sessions.select("doc", "id", "cwd", "branch"), "doc")
    own = uuid5(F.concat_ws(":", "id", "msg_idx"))
    parent = F.when(F.col("msg_idx") > 0, uuid5(F.concat_ws(":", F.col("id"), F.col("msg_idx") - 1)))
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    message = F.concat(F.lit('{"role":"'), "role", F.lit('","content":'), "content", F.lit("}"))
    fields = [_pair("type", quote(F.col("role"))), _pair("uuid", quote(own)), F.concat(F.lit('"parentUuid":'), F.coalesce(quote(parent), F.lit("null"))), _pair("sessionId", _quoted("id")), F.when(F.col("cwd").isNotNull(), F.concat(F.lit('"cwd":'), _quoted("cwd"))), F.when(F.col("branch").isNotNull(), F.concat(F.lit('"gitBranch":'), _quoted("branch"))), _pair("timestamp", quote(F.date_format("ts", _TS))), F.concat(F.lit('"message":'), message)]
    rows = m.select("doc", "msg_idx", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("r"))
    held = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "r"))).alias("p"))
    return held.select("doc", F.array_join(F.transform("p", lambda x: x["r"]), "\n").alias("text"))


RENDERERS = {"simple": to_simple, "claude_code": to_claude_code}


def convert(s: Sessions, target: str) -> DataFrame:
    """(doc, text) of sessions in another format."""
    if target not in RENDERERS:
        raise ValueError(f"no renderer for {target!r}: {', '.join(RENDERERS)}")
    return RENDERERS[target](s)


def write(s: Sessions, target: str, path: str) -> None:
    """Writes converted sessions as text, always as a new copy; an existing path is an error."""
    convert(s, target).select("text").write.mode("error").text(path)


def artifact_rows(artifacts: DataFrame) -> DataFrame:
    """(doc, name, data) of artifacts (doc, name, base64 or text): names that are safe, contents of 64 MiB at most."""
    data = F.coalesce(F.try_to_binary("base64", F.lit("base64")), F.encode("text", "UTF-8"))
    return artifacts.select("doc", safe_name(F.col("name")).alias("name"), data.alias("data")).where(F.octet_length("data") <= ARTIFACT_BYTES)

"""Queries on formats: sessions written natively and read back by the adapter of each format, with SQL on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import base, logs, native, steps, transcripts, trees  # noqa: F401  (they register the adapters)
from ..sources.base import Sessions
from . import canonical as c
from .catalogue import query

#: Formats that carry every block of the events, and what differs in each.
_EVENTS = {
    "pi": {},
    "campfire": {},
    "codex": {},
    "amp": {},
    "cowork_remote": {},
    "freebuff": {},
    "cursor": {},
    "hermes": {"is_error": "FALSE"},
}
_SQL = """SELECT replace(doc, 'simple:', '{harness}:') AS doc, msg_idx, role, type, coalesce(text, result) AS body, tool_id,
 CASE WHEN type = 'tool_use' THEN 'Bash' END AS tool_name, input AS tool_input, {is_error} AS is_error FROM ev"""


def event_sessions(spark, sf_dir: str) -> Sessions:
    blocks = c.event_blocks(spark, sf_dir)
    rows = blocks.groupBy("doc").agg(F.min("ts").alias("ts"))
    sessions = c.sessions(rows, harness=F.lit("simple"), id=F.split_part("doc", F.lit(":"), F.lit(2)), source=F.lit(None), ts=F.col("ts"), title=F.lit("Events"), cwd=F.lit("/work/events"), seq=F.xxhash64("doc"))
    return Sessions(sessions, blocks)


def _reread(s: Sessions, harness: str) -> Sessions:
    return base.ADAPTERS[harness](**native.native_tables(s, harness))


def _register(harness: str, differs: dict[str, str]) -> None:
    @query(f"{harness}_events", "ev", _SQL.format(harness=harness, **{"is_error": "event_type = 'error'", **differs}))
    def roundtrip(spark, sf_dir):
        rows = _reread(event_sessions(spark, sf_dir), harness).blocks
        return rows.select("doc", "msg_idx", "role", "type", F.coalesce("text", "result_text").alias("body"), "tool_id", "tool_name", F.col("tool_input_json").alias("tool_input"), "is_error")


for _harness, _differs in _EVENTS.items():
    _register(_harness, _differs)


_SAID = "SELECT '{h}:conv-' || conv_id AS doc, CAST(i AS INT) AS msg_idx, lower(trim(role)) AS role, text FROM conv"


def _register_texts(harness: str) -> None:
    @query(f"{harness}_texts", "conv", _SAID.format(h=harness))
    def roundtrip(spark, sf_dir):
        source = Sessions(c.conversation_sessions(spark, sf_dir), c.conversation_blocks(spark, sf_dir))
        return _reread(source, harness).blocks.select("doc", "msg_idx", "role", "text")


for _harness in ("claude_chat", "chatgpt", "opencode"):
    _register_texts(_harness)

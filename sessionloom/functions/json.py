"""JSON as VARIANT: typed reads, tools that fit exactly or stay raw, renames and drops of keys."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The typed tools' keys; ? marks an optional one.
TOOLS = {
    "Read": {"file_path": "string", "offset?": "bigint", "limit?": "bigint"},
    "Write": {"file_path": "string", "content": "string"},
    "Edit": {"file_path": "string", "old_string": "string", "new_string": "string", "replace_all?": "boolean"},
    "MultiEdit": {"file_path": "string", "edits": "array"},
    "Bash": {"command": "string", "workdir?": "string", "timeout_ms?": "bigint", "description?": "string", "run_in_background?": "boolean"},
}
#: Harnesses and the other names that each may be given by.
ALIASES: dict[str, list[str]] = {
    "claude_code": ["claude", "claude-code", "claudecode"],
    "claude_chat": ["claude-chat", "claude_web", "claude-web"],
    "chatgpt": ["chat_gpt", "chat-gpt", "openai_chat", "openai-chat"],
    "cowork_remote": ["cowork-remote", "cowork_cloud", "cowork-cloud"],
    "codex": [],
    "opencode": ["open_code", "open-code"],
    "pi": [],
    "campfire": [],
    "cursor": ["cursor_cli", "cursor-cli", "cursorcli"],
    "cursor_desktop": ["cursor-desktop", "cursordesktop", "cursor_ide", "cursor-ide"],
    "grok": ["grok_cli", "grok-cli", "grokcli", "grok_build", "grok-build"],
    "grok_bot": ["grok-bot", "grokbot", "grok_desktop", "grok-desktop"],
    "fx": ["fx_cli", "fx-cli", "fxcli", "vercel_fx", "vercel-fx"],
    "hermes": ["hermes_agent", "hermes-agent", "hermesagent"],
    "amp": ["ampcode", "amp_code", "amp-code"],
    "antigravity": ["agy", "antigravity_cli", "antigravity-cli", "anti-gravity"],
    "freebuff": ["free_buff", "free-buff", "freebuff_desktop", "freebuff-desktop"],
    "simple": ["simple_json", "simple-json"],
    "cowork": ["claude_cowork", "claude-cowork", "claude_desktop", "claude-desktop"],
}


def harness(name: str) -> str:
    """The harness that a name or alias means."""
    for own, others in ALIASES.items():
        if name == own or name in others:
            return own
    raise ValueError(f"unknown harness {name!r}")


def parse(c: Column) -> Column:
    """VARIANT, or null for text that isn't JSON."""
    return F.try_parse_json(c)


def text_at(v: Column, path: str) -> Column:
    """A string at a path; null for anything else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def bool_at(v: Column, path: str, default: bool = False) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(found) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(default))


def long_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def array_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def json_at(v: Column, path: str) -> Column:
    """Canonical JSON (compact, keys sorted) of what is at a path."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def is_string(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.lit(False))


def typed(name: Column, input_json: Column) -> Column:
    """Whether a tool call fits its typed form exactly: all needed keys, no other, each of its type."""
    v = parse(input_json)
    keys = F.json_object_keys(input_json)
    out = name.startswith("/") & F.coalesce(F.size(F.array_except(keys, F.array(F.lit("args")))) == 0, F.lit(False)) & (F.try_variant_get(v, "$.args", "string").isNotNull())
    for tool, fields in TOOLS.items():
        ok = F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k.rstrip("?")) for k in fields]))) == 0, F.lit(False))
        for k, kind in fields.items():
            path = "$." + k.rstrip("?")
            got = F.try_variant_get(v, path, "variant")
            shape = F.schema_of_variant(got)
            right = shape.startswith("ARRAY") if kind == "array" else shape == kind.upper()
            ok &= F.coalesce(right, F.lit(False)) | ((shape == "VOID") | got.isNull() if k.endswith("?") else F.lit(False))
        out |= (name == tool) & ok
    return out


def rename_keys(input_json: Column, names: dict[str, str]) -> Column:
    """A flat JSON object with keys renamed; a key whose new name is there already stays as it is."""
    m = F.from_json(input_json, "map<string,variant>")
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.to_json(F.transform_keys(m, lambda k, _: F.when(table[k].isNotNull() & ~F.array_contains(F.map_keys(m), table[k]), table[k]).otherwise(k)))


def drop_keys(input_json: Column, names: list[str]) -> Column:
    m = F.from_json(input_json, "map<string,variant>")
    return F.to_json(F.map_filter(m, lambda k, _: ~k.isin(names)))


def wrap_object(input_json: Column) -> Column:
    """An input that is no object as {"input": it}."""
    return F.when(F.coalesce(F.schema_of_variant(parse(input_json)).startswith("OBJECT"), F.lit(False)), input_json).otherwise(F.concat(F.lit('{"input":'), input_json, F.lit("}")))


def data_url(c: Column) -> Column:
    """struct(media_type, data) of a base64 data URL, or null."""
    pattern = r"(?s)^data:([^;,]+);base64,(.*)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("media_type"), F.regexp_extract(c, pattern, 2).alias("data")))


def timestamp(c: Column) -> Column:
    """RFC 3339 text to a timestamp; null if it is none."""
    return F.try_to_timestamp(c)


def epoch(c: Column, unit: str = "s") -> Column:
    """Seconds (with a fraction) or milliseconds since 1970 to a timestamp."""
    return F.timestamp_micros(F.floor(c.cast("double") * (1e6 if unit == "s" else 1e3)).cast("long"))


def metadata_specs(specs: list[str]) -> dict:
    """k=v or JSON objects, merged left to right, the last wins."""
    out: dict = {}
    for s in specs:
        if s.lstrip().startswith("{"):
            out.update(json.loads(s))
        else:
            k, sep, v = s.partition("=")
            if not sep or not re.fullmatch(r"\S+", k):
                raise ValueError(f"neither k=v nor a JSON object: {s!r}")
            out[k] = v
    return out

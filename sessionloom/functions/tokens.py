"""Token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_TOKENS = 1000


def estimate(text: Column) -> Column:
    """Characters over four, rounded up; null is 0."""
    return F.coalesce(F.expr("0L") + F.floor((F.length(text) + 3) / 4), F.lit(0)).cast("long")


def content_key(result_text: Column, result_json: Column) -> Column:
    """The text of a tool result, or its JSON."""
    return F.coalesce(result_text, result_json)


def block_tokens(b: dict[str, Column]) -> Column:
    """Tokens of a block: text and thinking by their text, a tool call by its input alone, a result by its content."""
    kind = b["type"]
    return (
        F.when(kind == "image", F.lit(IMAGE_TOKENS).cast("long"))
        .when(kind == "tool_use", estimate(b["tool_input_json"]))
        .when(kind == "tool_result", estimate(content_key(b["result_text"], b["result_json"])))
        .otherwise(estimate(b["text"]))
    )


def compressed(tokens: Column) -> Column:
    """What a compressed message costs: a tenth, rounded up."""
    return F.floor((tokens + 9) / 10).cast("long")

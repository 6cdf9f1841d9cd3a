"""What is shown of sessions: view filters, masked copies, examples, savings, prompts for a scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import parse
from ..functions.redaction import mask
from ..functions.text import flat_line
from .trim import COMPRESS, DROP, KEEP, allocate

FENCE = "```"


def view(blocks: DataFrame, user: bool = True, assistant: bool = True, tools: bool = True, reasoning: bool = True) -> DataFrame:
    """Blocks of the kinds that are asked for; a tool's call and result are tools, whoever's message they are in."""
    tool, thought = F.col("type").isin("tool_use", "tool_result"), F.col("type") == "thinking"
    plain = ~tool & ~thought
    return blocks.where((plain & (F.col("role") == "user") & user) | (plain & (F.col("role") == "assistant") & assistant) | (tool & tools) | (thought & reasoning))


def mask_json(c: Column) -> Column:
    """JSON text with credentials in its string values masked, keys as they are.

    The text is masked value by value where it is a flat object of strings; nested values are masked as JSON texts, which
    finds the same credentials and keeps the JSON valid, since no credential holds a quote."""
    flat = F.from_json(c, "map<string,variant>")
    masked = F.transform_values(flat, lambda _, v: F.coalesce(F.try_parse_json(F.when(F.schema_of_variant(v) == "STRING", _quote(mask(F.try_variant_get(v, "$", "string")))).otherwise(mask(F.to_json(v)))), v))
    return F.when(flat.isNull() | F.coalesce(~F.schema_of_variant(parse(c)).startswith("OBJECT"), F.lit(True)), mask(c)).otherwise(F.to_json(masked))


def _quote(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")


def masked(blocks: DataFrame) -> DataFrame:
    """Blocks for the screen: texts, thinking, results and calls' inputs masked; images and artifacts as they are."""
    shown = ~F.col("type").isin("image", "artifact")
    keep = lambda name, f: F.when(shown, f(F.col(name))).otherwise(F.col(name))
    return blocks.withColumns({"text": keep("text", mask), "result_text": keep("result_text", mask), "tool_input_json": keep("tool_input_json", mask_json), "result_json": keep("result_json", mask_json)})


def examples(items: DataFrame, n: int = 3) -> DataFrame:
    """The n largest messages of each decision in each session."""
    order = Window.partitionBy("doc", "decision").orderBy(F.desc("token_cost"), "msg_idx")
    return items.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def rejected_examples(verdicts: DataFrame, n: int = 2) -> DataFrame:
    """n candidates of each verdict but kept, the most relevant first."""
    order = Window.partitionBy("verdict").orderBy(F.desc("relevance"), "cand")
    return verdicts.where("verdict <> 'kept'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def savings_percent(before: Column, after: Column) -> Column:
    """Whole percent saved; null if there was nothing."""
    return F.when(before > 0, F.floor((before - after) * 100 / before))


def allocate_or_keep(items: DataFrame, blocks: DataFrame, budget: int, scored: DataFrame) -> DataFrame:
    """Allocation, but sessions that stay over the budget and have task scores (doc) keep the decisions that those made."""
    fitted, report = allocate(items, blocks, budget)
    over = report.where("status = 'over_budget'").select("doc").join(scored.select("doc").distinct(), "doc", "left_semi")
    return fitted.join(over, "doc", "left_anti").unionByName(items.select(*fitted.columns).join(over, "doc", "left_semi"))


def prompt_state(candidates: DataFrame, query: str) -> DataFrame:
    """One text for a scorer: the query and numbered candidates (rank, content), fences in them made harmless."""
    body = F.replace(flat_line(F.col("content")), F.lit(FENCE), F.lit("'''"))
    rows = candidates.select("rank", F.concat(F.lit("["), F.col("rank") + 1, F.lit("] "), body).alias("line"))
    held = rows.agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("p"))
    return held.select(F.concat_ws("\n", F.lit(f"Query: {query.replace(FENCE, chr(39) * 3)}"), F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("state"))


def decision_counts(items: DataFrame) -> DataFrame:
    """One row per session, one column per decision."""
    return items.groupBy("doc").pivot("decision", [KEEP, COMPRESS, DROP]).count().na.fill(0)


def parent_lineage(sessions: DataFrame, parents: DataFrame) -> DataFrame:
    """(doc, parent): the id that a parent's file (doc, parent_file) has in its header, else its name without .jsonl."""
    own = sessions.select(F.col("file").alias("parent_file"), F.col("id").alias("header_id"))
    stem = F.when(F.col("parent_file").endswith(".jsonl"), F.regexp_extract("parent_file", r"([^/\\]+)\.jsonl$", 1))
    return parents.join(own, "parent_file", "left").select("doc", F.coalesce("header_id", stem).alias("parent")).where("parent is not null")

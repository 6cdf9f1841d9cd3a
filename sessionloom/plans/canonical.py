"""The canonical tables, and how the driver's tables stand for sessions.

sessions: doc (key), harness, id, source, ts, updated_at, cwd, branch, title, cli_version, model, seq (order of insertion)
blocks:   doc, msg_idx, block_idx, role, ts, type, text, tool_id, tool_name, tool_input_json, result_text, result_json, is_error
lines:    doc, msg_idx (null for a session's header), block_idx, line_idx, origin, line
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_lines, trim_end

ORIGINS = ["meta", "user", "assistant", "thinking", "tool_use", "tool_result"]
DEFAULT_ORIGINS = [o for o in ORIGINS if o != "tool_result"]
SESSION_COLUMNS = "doc harness id source ts updated_at cwd branch title cli_version model seq".split()
BLOCK_TYPES = {"doc": "string", "msg_idx": "int", "block_idx": "int", "role": "string", "ts": "timestamp", "type": "string", "text": "string", "tool_id": "string", "tool_name": "string", "tool_input_json": "string", "result_text": "string", "result_json": "string", "is_error": "boolean"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(harness: Column, doc_id: Column, source: Column | None = None) -> Column:
    """harness:id, with @source where copies share an id."""
    key = F.concat(harness, F.lit(":"), doc_id)
    return key if source is None else F.when(source.isNull(), key).otherwise(F.concat(key, F.lit("@"), source))


def sessions(df: DataFrame, **columns: Column) -> DataFrame:
    """A sessions table from any columns given; the others are null."""
    kinds = {"ts": "timestamp", "updated_at": "timestamp", "seq": "long"}
    columns.setdefault("harness", F.lit("simple"))
    columns.setdefault("doc", doc_key(columns["harness"], columns["id"]))
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in SESSION_COLUMNS])


def blocks(df: DataFrame, **columns: Column) -> DataFrame:
    """A blocks table from any columns given; the others are null (is_error: false)."""
    columns.setdefault("is_error", F.lit(False))
    columns.setdefault("block_idx", F.lit(0))
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in BLOCK_TYPES.items()])


def _start(hours: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + hours * 3600)


def conversation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id")
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return sessions(rows, id=F.concat(F.lit("conv-"), n), ts=_start(n), cwd=F.concat(F.lit("/work/repo-"), n % 7), branch=F.when(n % 2 == 0, "main"), model=F.concat(F.lit("Model-"), n % 3), title=F.when(n % 5 == 0, F.concat(F.lit("Session "), n)), seq=n)


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.lower(F.trim("role"))
    rows = read(spark, sf_dir, "conversations").withColumn("r", role).where(F.col("r").isin("user", "assistant"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return blocks(rows, doc=F.concat(F.lit("simple:conv-"), "conv_id"), msg_idx=F.col("i"), role=F.col("r"), type=F.lit("text"), text=F.col("text"), ts=_start(F.col("conv_id")))


def document_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return sessions(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), id=F.concat(F.lit("doc-"), n), ts=_start(n), cwd=F.concat(F.lit("/work/"), "source"), branch=F.col("lang"), seq=n)


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(read(spark, sf_dir, "documents"), doc=F.concat(F.lit("simple:doc-"), "doc_id"), msg_idx=F.lit(0), role=F.lit("assistant"), type=F.lit("text"), text=F.col("text"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t"), F.max("ts").alias("u"))
    return sessions(rows, id=F.concat(F.lit("user-"), "user_id"), ts=F.col("t"), updated_at=F.col("u"), cwd=F.lit("/work/events"), seq=F.col("user_id"))


def event_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view: a call; purchase and error: results, an error one; signup: the user's text; click: the assistant's."""
    rows = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    kind = F.col("event_type")
    result = kind.isin("purchase", "error")
    body = F.repeat(F.concat(F.lit("line of output "), "k", F.lit(" ")), (F.lit(1) + F.col("k") * 2).cast("int"))
    return blocks(
        rows,
        doc=F.concat(F.lit("simple:user-"), "user_id"),
        msg_idx=F.col("i"),
        ts=F.col("ts"),
        role=F.when(result | (kind == "signup"), "user").otherwise("assistant"),
        type=F.when(kind == "view", "tool_use").when(result, "tool_result").otherwise("text"),
        text=F.when(kind.isin("signup", "click"), F.concat(kind, F.lit(" item "), (F.col("k") % 10))),
        tool_id=F.when(result | (kind == "view"), F.col("k")),
        tool_name=F.when(kind == "view", "Bash"),
        tool_input_json=F.when(kind == "view", F.concat(F.lit('{"command":"show '), "k", F.lit('"}'))),
        result_text=F.when(result, body),
        is_error=kind == "error",
    )


def lines(sessions_df: DataFrame, blocks_df: DataFrame) -> DataFrame:
    """Searchable lines: title, cwd and branch of the header, then every block's lines, white space at their ends cut, blank
    ones dropped.  Images have none; a call has its name and, unless it is null, its input."""
    head = sessions_df.select("doc", F.posexplode(F.array("title", "cwd", "branch")).alias("line_idx", "line"))
    head = head.select("doc", F.lit(None).cast("int").alias("msg_idx"), F.lit(0).alias("block_idx"), "line_idx", F.lit("meta").alias("origin"), "line").where("line is not null")
    call = F.concat_ws("\n", "tool_name", F.when(F.col("tool_input_json") != "null", F.col("tool_input_json")))
    body = F.when(F.col("type") == "tool_use", call).when(F.col("type") == "tool_result", F.coalesce("result_text", "result_json")).when(F.col("type") != "image", F.col("text"))
    origin = F.when(F.col("type").isin("thinking", "tool_use", "tool_result"), F.col("type")).otherwise(F.col("role"))
    rest = blocks_df.select("doc", "msg_idx", "block_idx", origin.alias("origin"), F.posexplode(split_lines(body)).alias("line_idx", "line"))
    rest = rest.select("doc", "msg_idx", "block_idx", "line_idx", "origin", "line")
    out = head.unionByName(rest).withColumn("line", trim_end(F.col("line")))
    return out.where(F.length(F.regexp_replace("line", r"(?U)\s+", "")) > 0)

"""Structure of sessions: tool pairs, crops, spans, groups, islands, text projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _tool_events(blocks: DataFrame) -> DataFrame:
    """Calls and results, each with what came before it for the same id; results before the first call are left out."""
    rows = blocks.where(F.col("type").isin("tool_use", "tool_result") & F.col("tool_id").isNotNull())
    rows = rows.select("doc", "tool_id", "msg_idx", "block_idx", (F.col("type") == "tool_use").alias("call"))
    order = Window.partitionBy("doc", "tool_id").orderBy("msg_idx", "block_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.max("call").over(so_far)).where("open")
    return rows.withColumns({"before": F.lag("call").over(order), "call_msg": F.lag("msg_idx").over(order)})


def ambiguous_sessions(blocks: DataFrame) -> DataFrame:
    """Sessions in which a call follows a call, or a result a result, under one id."""
    return _tool_events(blocks).where(F.col("before") == F.col("call")).select("doc").distinct()


def tool_pairs(blocks: DataFrame) -> DataFrame:
    """(doc, tool_id, call, result): message indices of calls and their results; ambiguous sessions have none."""
    rows = _tool_events(blocks).withColumn("bad", F.max(F.coalesce(F.col("before") == F.col("call"), F.lit(False))).over(Window.partitionBy("doc")))
    return rows.where("not bad and not call").select("doc", "tool_id", F.col("call_msg").alias("call"), F.col("msg_idx").alias("result"), F.col("block_idx").alias("result_block"))


def message_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc").agg((F.max("msg_idx") + 1).alias("n"))


def kept_indices(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """Messages of the union of half-open spans (doc, start, end), each once; spans out of bounds are left out."""
    rows = spans.join(counts, "doc").where("start >= 0 and start < end and end <= n")
    return rows.select("doc", F.explode(F.sequence("start", F.col("end") - 1)).alias("msg_idx")).distinct()


def crop(blocks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks within the spans, and the pairs that the spans would split (doc, call, result): not empty is an error."""
    kept = kept_indices(spans, message_counts(blocks))
    pairs = tool_pairs(blocks).join(spans.select("doc").distinct(), "doc", "left_semi")
    has = lambda c: kept.select("doc", F.col("msg_idx").alias(c), F.lit(True).alias(f"has_{c}"))
    split = pairs.join(has("call"), ["doc", "call"], "left").join(has("result"), ["doc", "result"], "left")
    split = split.where(F.col("has_call").isNull() != F.col("has_result").isNull()).select("doc", "call", "result")
    return blocks.join(kept, ["doc", "msg_idx"], "left_semi"), split


def islands(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Runs of consecutive indices as half-open ranges (keys, start, end)."""
    order = Window.partitionBy(*keys).orderBy(index)
    runs = rows.select(*keys, index).distinct().withColumn("run", F.col(index) - F.row_number().over(order))
    return runs.groupBy(*keys, "run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end")).drop("run")


def nearest_span(pairs: DataFrame, spans: DataFrame, steps: int = 64) -> DataFrame:
    """The smallest span around each span (doc, start, end) that splits no pair with an end inside it.

    A pair with both ends outside does not count.  Spans grow to a fixpoint, in one window of pairs per session and step;
    a session's pairs are held in one array, so a step is no join."""
    held = pairs.groupBy("doc").agg(F.collect_list(F.struct(F.least("call", "result").alias("a"), F.greatest("call", "result").alias("b"))).alias("pairs"))
    rows = spans.join(held, "doc", "left")

    def grow(s: pd.Series, e: pd.Series, p: pd.Series) -> Iterator[tuple[int, int]]:
        for start, end, found in zip(s, e, p, strict=True):
            left = [(x["a"], x["b"]) for x in found] if found is not None else []
            while True:
                touched = [(a, b) for a, b in left if start <= a < end or start <= b < end]
                new = min([start, *(a for a, _ in touched)]), max([end, *(b + 1 for _, b in touched)])
                if new == (start, end):
                    break
                start, end = new
            yield start, end

    @F.pandas_udf("start int, end int")
    def nearest(s: pd.Series, e: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(grow(s, e, p)), columns=["start", "end"])

    return rows.withColumn("near", nearest("start", "end", "pairs")).select("doc", "start", "end", F.col("near.start").alias("near_start"), F.col("near.end").alias("near_end"))


def pair_groups(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc, msg_idx, grp) for every message: the groups that pairs join, and each group's label.

    Pairs come in the order of their results; a result's label becomes its call's.  Sessions without pairs never reach Python."""

    @F.pandas_udf("array<struct<i:int,g:int>>")
    def label(found: pd.Series) -> pd.Series:
        out = []
        for pairs_ in found:
            labels: dict[int, int] = {}
            members: dict[int, list[int]] = {}
            for p in pairs_:
                for i in (p["call"], p["result"]):
                    if i not in labels:
                        labels[i], members[i] = i, [i]
                kept, merged = labels[p["call"]], labels[p["result"]]
                if kept != merged:
                    for i in members[merged]:
                        labels[i] = kept
                    members[kept] += members.pop(merged)
            out.append([{"i": i, "g": g} for i, g in labels.items()])
        return pd.Series(out)

    held = pairs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("result", "result_block", "call"))).alias("pairs"))
    joined = held.select("doc", F.explode(label("pairs")).alias("x")).select("doc", F.col("x.i").alias("msg_idx"), F.col("x.g").alias("g"))
    every = counts.select("doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("msg_idx"))
    return every.join(joined, ["doc", "msg_idx"], "left").select("doc", "msg_idx", F.coalesce("g", "msg_idx").alias("grp"))


def message_kinds(blocks: DataFrame) -> DataFrame:
    """(doc, msg_idx, kind): tool_result if all blocks of a user's message are results, tool_call if an assistant's has one."""
    rows = blocks.groupBy("doc", "msg_idx").agg(F.first("role").alias("role"), F.bool_and(F.col("type") == "tool_result").alias("all"), F.bool_or(F.col("type") == "tool_use").alias("any"))
    kind = F.when(F.col("role") == "user", F.when(F.col("all"), "tool_result").otherwise("user")).otherwise(F.when(F.col("any"), "tool_call").otherwise("assistant"))
    return rows.select("doc", "msg_idx", kind.alias("kind"))


def _short_ids(blocks: DataFrame) -> DataFrame:
    """(doc, tool_id, short): 1, 2, ... by first use."""
    first = blocks.where("tool_id is not null").groupBy("doc", "tool_id").agg(F.min(F.struct("msg_idx", "block_idx")).alias("f"))
    return first.select("doc", "tool_id", F.row_number().over(Window.partitionBy("doc").orderBy("f")).alias("short"))


def text_projection(blocks: DataFrame, ordinals: bool = False) -> DataFrame:
    """(doc, body): a session as labelled text, in order; calls and results by short ids, images left out, empty inputs blank.

    With ordinals, each message starts with its number in the whole session."""
    rows = blocks.where("type <> 'image'").join(_short_ids(blocks), ["doc", "tool_id"], "left")
    body = F.when(F.col("type") == "tool_use", F.when(F.col("tool_input_json").isin("null", "{}"), "").otherwise(F.col("tool_input_json"))).when(F.col("type") == "tool_result", F.coalesce("result_text", "result_json")).otherwise(F.col("text"))
    short = F.concat(F.lit("#"), F.col("short"))
    label = (
        F.when(F.col("type") == "tool_use", F.concat(F.lit("[tool "), short, F.lit(" "), "tool_name", F.lit("]")))
        .when(F.col("type") == "tool_result", F.concat(F.lit("[result "), short, F.when(F.col("is_error"), " error").otherwise(""), F.lit("]")))
        .when(F.col("type") == "thinking", "[thinking]")
        .otherwise(F.concat(F.lit("["), "role", F.lit("]")))
    )
    section = F.concat(F.coalesce(label, F.lit("[tool]")), F.lit("\n"), F.coalesce(body, F.lit("")))
    if ordinals:
        first = F.row_number().over(Window.partitionBy("doc", "msg_idx").orderBy("block_idx")) == 1
        section = F.concat(F.when(first, F.concat(F.lit("── #"), F.col("msg_idx") + 1, F.lit(" ──\n"))).otherwise(""), section)
    rows = rows.select("doc", "msg_idx", "block_idx", section.alias("s"))
    parts = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "block_idx", "s"))).alias("p"))
    return parts.select("doc", F.array_join(F.transform("p", lambda x: x["s"]), "\n\n").alias("body"))


def byte_chunks(sizes: DataFrame, limit: int) -> DataFrame:
    """(doc, chunk, start, end): consecutive messages (doc, msg_idx, bytes) cut where the sum would pass the limit.

    A message over the limit is a chunk of its own.  The sum starts again at each cut, so it is a fold over a session's
    sizes, in Spark's own array functions."""
    held = sizes.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("msg_idx", F.col("bytes").cast("long").alias("bytes")))).alias("m"))
    zero = F.struct(F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<msg_idx:int,chunk:int>>").alias("out"))

    def step(a, x):
        new = (a["chunk"] < 0) | (a["sum"] + x["bytes"] > limit)
        chunk = (a["chunk"] + new.cast("int")).alias("chunk")
        row = F.struct(x["msg_idx"].cast("int").alias("msg_idx"), (a["chunk"] + new.cast("int")).alias("chunk"))
        return F.struct(chunk, F.when(new, x["bytes"]).otherwise(a["sum"] + x["bytes"]).alias("sum"), F.array_append(a["out"], row).alias("out"))

    rows = held.select("doc", F.explode(F.aggregate("m", zero, step)["out"]).alias("r")).select("doc", "r.*")
    return rows.groupBy("doc", "chunk").agg(F.min("msg_idx").alias("start"), (F.max("msg_idx") + 1).alias("end"))

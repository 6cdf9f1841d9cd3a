"""Trimming: scores, decisions, allocation to a token budget, stand-ins.

Numbers that are 32-bit floats in the model stay FloatType: thresholds are compared in that width.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import block_tokens, compressed, content_key
from .structure import pair_groups, tool_pairs

KEEP, COMPRESS, DROP = "keep", "compress", "drop"
#: Characters that a stand-in keeps of each text, and what follows them.
STAND_IN, CUT_MARK = 160, "…[trimmed: truncated]"


@dataclass
class Rules:
    keep_importance: float = 0.6
    drop_redundancy: float = 0.5
    drop_utility: float = 0.6
    compress_tokens: int = 400
    floor_importance: float = 0.6


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _sum32(*parts: Column) -> Column:
    """Additions in order, each rounded to 32 bits."""
    total = parts[0]
    for p in parts[1:]:
        total = f32(total + p)
    return total


def _clamp(c: Column) -> Column:
    return F.greatest(f32(0.0), F.least(f32(1.0), c))


def redundancy(blocks: DataFrame) -> DataFrame:
    """(doc, msg_idx, redundancy): sightings before over all, of the most repeated text or result of a message."""
    rows = blocks.where(F.col("type").isin("text", "tool_result"))
    key = F.when(F.col("type") == "text", F.col("text")).otherwise(content_key(F.col("result_text"), F.col("result_json")))
    rows = rows.select("doc", "msg_idx", "block_idx", F.coalesce(key, F.lit("")).alias("key"))
    by_key = Window.partitionBy("doc", "key")
    share = f32(f32(F.row_number().over(by_key.orderBy("msg_idx", "block_idx")) - 1) / f32(F.count("*").over(by_key)))
    return rows.withColumn("share", share).groupBy("doc", "msg_idx").agg(F.max("share").alias("redundancy"))


def score(blocks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A row per message: importance, future_utility, redundancy, token_cost, decision; a pair is never half dropped."""
    rules = rules or Rules()
    b = {c: F.col(c) for c in blocks.columns}
    one = blocks.groupBy("doc", "msg_idx").agg(
        F.bool_or((F.col("role") == "user") & (F.col("type") == "text")).alias("user_text"),
        F.bool_or(F.col("type") == "tool_use").alias("call"),
        F.bool_or(F.col("type") == "tool_result").alias("result"),
        F.bool_or((F.col("type") == "tool_result") & F.col("is_error")).alias("error"),
        F.sum(block_tokens(b)).cast("long").alias("token_cost"),
    )
    session = Window.partitionBy("doc")
    n, place = F.count("*").over(session), F.row_number().over(session.orderBy("msg_idx"))
    one = one.withColumns({"n": n, "place": place, "objective": F.min(F.when(F.col("user_text"), F.col("msg_idx"))).over(session)})
    plus = lambda cond, x: F.when(cond, f32(x)).otherwise(f32(0.0))
    importance = _sum32(f32(0.4), plus(F.col("user_text"), 0.35), plus(F.coalesce(F.col("objective") == F.col("msg_idx"), F.lit(False)), 0.2), plus(F.col("error"), 0.3), plus(F.col("call"), 0.1))
    recency = F.when(F.col("n") == 1, f32(1.0)).otherwise(f32(f32(F.col("place")) / f32(F.col("n"))))
    utility = _sum32(f32(f32(0.5) * recency), plus(F.col("error"), 0.3), plus(F.col("call"), 0.15), plus(F.col("place") == F.col("n"), 0.2))
    rows = one.join(redundancy(blocks), ["doc", "msg_idx"], "left")
    rows = rows.select("doc", "msg_idx", _clamp(importance).alias("importance"), _clamp(utility).alias("future_utility"), F.coalesce("redundancy", f32(0.0)).alias("redundancy"), "token_cost", "result")
    worth = f32(F.col("future_utility") * f32(f32(1.0) - F.col("redundancy")))
    decision = (
        F.when(F.col("importance") >= f32(rules.keep_importance), KEEP)
        .when((F.col("redundancy") >= f32(rules.drop_redundancy)) & (worth <= f32(rules.drop_utility)), DROP)
        .when(F.col("result") & (F.col("token_cost") >= rules.compress_tokens), COMPRESS)
        .otherwise(KEEP)
    )
    rows = rows.withColumn("own", decision).drop("result")
    # A dropped half of a pair whose other half stays is compressed instead.
    pairs = tool_pairs(blocks).select("doc", "call", "result")
    own = rows.select("doc", "msg_idx", "own")
    both = pairs.join(own.withColumnsRenamed({"msg_idx": "call", "own": "a"}), ["doc", "call"]).join(own.withColumnsRenamed({"msg_idx": "result", "own": "b"}), ["doc", "result"])
    return rows, both


def decide(blocks: DataFrame, rules: Rules | None = None) -> DataFrame:
    """score() with the final decision of each message."""
    rows, both = score(blocks, rules)
    torn = both.where((F.col("a") == DROP) | (F.col("b") == DROP))
    safe = torn.select("doc", F.explode(F.array("call", "result")).alias("msg_idx")).distinct().withColumn("paired", F.lit(True))
    rows = rows.join(safe, ["doc", "msg_idx"], "left")
    return rows.select("doc", "msg_idx", "importance", "future_utility", "redundancy", "token_cost", F.when(F.col("paired") & (F.col("own") == DROP), COMPRESS).otherwise(F.col("own")).alias("decision"))


def plan_report(items: DataFrame) -> DataFrame:
    """Per session: tokens before and selected, and how many are kept, compressed and dropped."""
    return items.groupBy("doc").agg(
        F.sum("token_cost").alias("original_tokens"),
        F.coalesce(F.sum(F.when(F.col("decision") != DROP, F.col("token_cost"))), F.lit(0)).alias("selected_tokens"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in (KEEP, COMPRESS, DROP)],
    )


def cost(decision: Column, tokens: Column) -> Column:
    return F.when(decision == KEEP, tokens).when(decision == COMPRESS, compressed(tokens)).otherwise(0)


def allocate(items: DataFrame, blocks: DataFrame, budget: int | None, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Items with decisions that fit the budget, and a report per session: status, tokens, counts, demotions.

    Savings only grow along a ladder's order, so the demoted items are a prefix of it: those before which the running total
    still is over the budget.  Without a budget nothing changes."""
    rules = rules or Rules()
    if budget is None:
        report = plan_report(items).select("doc", F.lit("fits").alias("status"), "selected_tokens", KEEP, COMPRESS, DROP, F.lit(0).cast("long").alias("full_to_compressed"), F.lit(0).cast("long").alias("compressed_to_dropped"))
        return items, report
    session = Window.partitionBy("doc")
    rows = items.withColumn("protected", F.col("importance") >= f32(rules.floor_importance))
    rows = rows.withColumn("start", F.sum(cost(F.col("decision"), F.col("token_cost"))).over(session))
    # Full to compressed, the least valuable first.
    can = (F.col("decision") == KEEP) & ~F.col("protected")
    saving = F.when(can, F.col("token_cost") - compressed(F.col("token_cost"))).otherwise(0)
    ladder = session.orderBy(F.desc("can"), "importance", "future_utility", F.desc("token_cost"), F.desc("msg_idx")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"can": can, "saving": saving})
    rows = rows.withColumn("demoted", F.col("can") & (F.col("start") - F.coalesce(F.sum("saving").over(ladder), F.lit(0)) > budget))
    rows = rows.withColumn("decision", F.when(F.col("demoted"), COMPRESS).otherwise(F.col("decision")))
    rows = rows.withColumn("middle", F.col("start") - F.sum(F.when(F.col("demoted"), F.col("saving")).otherwise(0)).over(session))
    # Compressed groups to dropped, a pair with both its halves.
    groups = pair_groups(tool_pairs(blocks), items.groupBy("doc").agg((F.max("msg_idx") + 1).alias("n")))
    rows = rows.join(groups, ["doc", "msg_idx"])
    group = rows.groupBy("doc", "grp").agg(F.bool_and((F.col("decision") == COMPRESS) & ~F.col("protected")).alias("ok"), F.min("importance").alias("gi"), F.min("future_utility").alias("gu"), F.sum(compressed(F.col("token_cost"))).alias("gs"), F.first("middle").alias("middle")).where("ok")
    order = session.orderBy("gi", "gu", "grp").rowsBetween(Window.unboundedPreceding, -1)
    gone = group.where(F.lit(True)).withColumn("left", F.col("middle") - F.coalesce(F.sum("gs").over(order), F.lit(0))).where(F.col("left") > budget).select("doc", "grp", F.lit(True).alias("gone"))
    rows = rows.join(gone, ["doc", "grp"], "left")
    rows = rows.withColumn("decision", F.when(F.col("gone"), DROP).otherwise(F.col("decision")))
    out = rows.select("doc", "msg_idx", "importance", "future_utility", "redundancy", "token_cost", "decision", "demoted", F.coalesce("gone", F.lit(False)).alias("gone"))
    report = out.groupBy("doc").agg(
        F.sum(cost(F.col("decision"), F.col("token_cost"))).alias("selected_tokens"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in (KEEP, COMPRESS, DROP)],
        F.count_if("demoted").alias("full_to_compressed"),
        F.count_if("gone").alias("compressed_to_dropped"),
    )
    status = F.when(F.col("selected_tokens") > budget, "over_budget").when(F.col("full_to_compressed") + F.col("compressed_to_dropped") == 0, "fits").otherwise("demoted")
    return out.drop("demoted", "gone"), report.select("doc", status.alias("status"), "selected_tokens", KEEP, COMPRESS, DROP, "full_to_compressed", "compressed_to_dropped")


def apply(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks of a trimmed session: dropped messages gone, compressed ones cut to stand-ins with a last block that says where
    the original is, and new_idx, the messages' places in what is left."""
    session = Window.partitionBy("doc")
    kept = items.where(F.col("decision") != DROP).withColumn("new_idx", F.row_number().over(session.orderBy("msg_idx")) - 1)
    rows = blocks.join(kept.select("doc", "msg_idx", "new_idx", "decision", "token_cost"), ["doc", "msg_idx"])
    small = F.col("decision") == COMPRESS
    cut = lambda c: F.when(small & (F.length(c) > STAND_IN), F.concat(F.left(c, F.lit(STAND_IN)), F.lit(CUT_MARK))).otherwise(F.col(c))
    body = rows.withColumns({"text": F.when(F.col("type") == "text", cut("text")).otherwise(F.col("text")), "result_text": cut("result_text")})
    last = rows.where(small).groupBy("doc", "msg_idx", "new_idx", "role", "ts", "decision", "token_cost").agg((F.max("block_idx") + 1).alias("block_idx"))
    note = F.concat(F.lit("[message "), "msg_idx", F.lit(" of "), "doc", F.lit(" compressed from ~"), "token_cost", F.lit(" tokens; see "), "doc", F.lit("#"), F.col("msg_idx") + 1, F.lit("]"))
    notes = last.select(*[F.col(c) if c in last.columns else (note if c == "text" else F.lit("text") if c == "type" else F.lit(False) if c == "is_error" else F.lit(None)).cast(body.schema[c].dataType).alias(c) for c in body.columns])
    return body.unionByName(notes)


def relevance_weighted(items: DataFrame, relevance: DataFrame) -> DataFrame:
    """Importance scaled by (doc, msg_idx, relevance) where there is one: 0.55 of it is left at a relevance of 0."""
    rows = items.join(relevance, ["doc", "msg_idx"], "left")
    factor = f32(f32(0.55) + f32(f32(f32(1.0) - f32(0.55)) * F.col("relevance")))
    scaled = _clamp(f32(F.col("importance") * factor))
    return rows.withColumn("importance", F.when(F.col("relevance").isNull(), F.col("importance")).otherwise(scaled)).drop("relevance")


def task_decisions(items: DataFrame, blocks: DataFrame, relevance: DataFrame) -> DataFrame:
    """Decisions by relevance to a task (doc, msg_idx, relevance): 0.7 keeps, under 0.3 drops, else short messages stay and
    long ones are compressed.  Important messages, and those without a score, are as they were.  Of a group of pairs of which
    something stays, nothing is dropped."""
    rows = items.join(relevance, ["doc", "msg_idx"], "left")
    free = F.col("relevance").isNotNull() & (F.col("importance") < f32(0.6))
    short = F.when(F.col("token_cost") < 150, KEEP).otherwise(COMPRESS)
    asked = F.when(F.col("relevance") >= f32(0.7), KEEP).when(F.col("relevance") < f32(0.3), DROP).otherwise(short)
    rows = rows.withColumns({"decision": F.when(free, asked).otherwise(F.col("decision")), "importance": F.when(free, f32(F.col("relevance") * f32(0.59))).otherwise(F.col("importance"))})
    groups = pair_groups(tool_pairs(blocks), items.groupBy("doc").agg((F.max("msg_idx") + 1).alias("n")))
    rows = rows.join(groups, ["doc", "msg_idx"])
    group = Window.partitionBy("doc", "grp")
    lifted = (F.col("decision") == DROP) & (F.count("*").over(group) > 1) & F.bool_or(F.col("decision") != DROP).over(group)
    return rows.withColumn("decision", F.when(lifted, short).otherwise(F.col("decision"))).drop("relevance", "grp")

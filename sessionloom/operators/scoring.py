"""Pluggable scorers: candidates out in batches, decisions back, checked and reconciled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import Options, excerpt, select_within
from .trim import f32

BATCH = 64
Ranker = Callable[[str, pd.DataFrame], pd.DataFrame]


def rank_with(candidates: DataFrame, query: str, ranker: Ranker) -> DataFrame:
    """Decisions (cand, relevance, retrieve) of a ranker for candidates (cand, content), BATCH of them at a time.

    The ranker gets frames (cand, content), content as an excerpt, and answers frames (cand, probability).  A probability that is not finite
    is an error; others are cut to 0..1, and 0.5 retrieves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                got = ranker(query, frame.iloc[at : at + BATCH])
                p = got["probability"].astype("float32")
                if not (p.abs() < float("inf")).all():
                    raise ValueError("a scorer's probability is not finite")
                p = p.clip(0, 1)
                yield pd.DataFrame({"cand": got["cand"], "relevance": p, "retrieve": p >= 0.5})

    return candidates.select("cand", excerpt(F.col("content")).alias("content")).mapInPandas(run, "cand string, relevance float, retrieve boolean")


def missing(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates that have no decision."""
    return candidates.select("cand").join(decisions.select("cand"), "cand", "left_anti")


def unknown(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on no candidate."""
    return decisions.select("cand").join(candidates.select("cand"), "cand", "left_anti").distinct()


def repeated(decisions: DataFrame) -> DataFrame:
    """Candidates decided on twice."""
    return decisions.groupBy("cand").count().where("count > 1").select("cand")


def reconcile(candidates: DataFrame, decisions: DataFrame, options: Options) -> DataFrame:
    """The selected candidates, with `rank`: retrieved, at the scorer's floor, within the limits.

    One decision for each candidate is the contract; missing(), unknown() and repeated() tell what breaks it."""
    rows = candidates.drop("relevance", "rank").join(decisions, "cand").withColumn("relevance", _clamped())
    rows = rows.where(F.col("retrieve") & (F.col("relevance") >= f32(options.min_scorer_relevance)))
    return select_within(rows, options.max_chunks, options.max_tokens)


def _clamped():
    return F.greatest(f32(0.0), F.least(f32(1.0), F.col("relevance")))


def verdicts(candidates: DataFrame, decisions: DataFrame, selected: DataFrame, options: Options) -> DataFrame:
    """(cand, relevance, verdict): kept, rejected, below_floor or over_limit."""
    rows = candidates.select("cand").join(decisions, "cand").withColumn("relevance", _clamped())
    rows = rows.join(selected.select("cand", F.lit(True).alias("kept")), "cand", "left")
    verdict = F.when(F.col("kept"), "kept").when(~F.col("retrieve"), "rejected").when(F.col("relevance") < f32(options.min_scorer_relevance), "below_floor").otherwise("over_limit")
    return rows.select("cand", "relevance", verdict.alias("verdict"))


def numbered(rows: DataFrame) -> DataFrame:
    """Verdicts in the order in which they are told, with `pos`: the most relevant first, then by candidate.

    The order is of one answer's candidates, at most a scorer's widened number of them, not of the corpus."""
    order = Window.orderBy(F.desc("relevance"), "cand")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def message_texts(blocks: DataFrame) -> DataFrame:
    """(doc, msg_idx, content, batch): what a scorer sees of a session's messages, blank ones left out, in batches."""
    body = F.when(F.col("type") == "text", F.col("text")).otherwise(F.coalesce("result_text", "result_json"))
    rows = blocks.where(F.col("type").isin("text", "tool_result")).groupBy("doc", "msg_idx").agg(F.sort_array(F.collect_list(F.struct("block_idx", body.alias("b")))).alias("p"))
    rows = rows.select("doc", "msg_idx", F.array_join(F.transform("p", lambda x: x["b"]), "\n").alias("content"))
    rows = rows.where(F.length(F.regexp_replace("content", r"(?U)\s+", "")) > 0)
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("msg_idx")) - 1
    return rows.withColumn("batch", F.floor(nth / BATCH))

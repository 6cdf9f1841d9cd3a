"""Verbs that compose the other operators: retrieval over filtered sessions, retrieval with a budget, and the handoff."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import estimate
from ..plans import canonical as c
from ..sources import native, render
from ..sources.base import Sessions
from . import retrieval, trim
from .retrieval import Options


class Fingerprint(NamedTuple):
    """What tells that a session is a copy of another: its first text, or its title and cwd."""

    first_text: str | None = None
    title: str | None = None
    cwd: str | None = None


def retrieve_local(s: Sessions, query: str, now: datetime, options: Options | None = None, copies_of: Fingerprint | None = None) -> DataFrame:
    """retrieve() over all sessions but those that are excluded: by id, and with copies_of that session's copies and sessions
    that a handoff has made.  What is excluded goes before any line is looked at."""
    options = options or Options()
    sessions = s.sessions
    if options.exclude_sessions:
        sessions = sessions.where(~F.col("id").isin(options.exclude_sessions))
    if copies_of is not None:
        sessions = retrieval.exclude_handoffs(retrieval.exclude_copies(sessions, s.blocks, *copies_of), s.blocks)
    blocks = s.blocks.join(sessions.select("doc"), "doc", "left_semi")
    return retrieval.retrieve(sessions, c.lines(sessions, blocks), query, now, options)


def assembled(chunks: DataFrame, query: str, doc: str) -> DataFrame:
    """The blocks of assemble(), as the one session `doc`."""
    return c.blocks(retrieval.assemble(chunks, query), doc=F.lit(doc), msg_idx=F.col("msg_idx"), role=F.col("role"), type=F.lit("text"), text=F.col("text"), is_error=F.lit(False))


def relevance_by_position(chunks: DataFrame, doc: str) -> DataFrame:
    """(doc, msg_idx, relevance): of each message of assemble(), the relevance of its chunk; the query has none."""
    places = retrieval.chunk_origins(chunks.select("id", "msg_idx", "relevance", "rank"))
    own = chunks.select("id", F.coalesce("msg_idx", F.lit(0)).alias("source_idx"), "relevance")
    return places.join(own, ["id", "source_idx"]).select(F.lit(doc).alias("doc"), "msg_idx", "relevance")


class Retrieved(NamedTuple):
    """chunks; blocks of the assembled and of the optimized session; the budget's report; tokens (before, after)."""

    chunks: DataFrame
    assembled: DataFrame
    optimized: DataFrame
    report: DataFrame
    tokens: DataFrame


def retrieve_and_optimize(s: Sessions, query: str, now: datetime, options: Options | None = None, budget: int | None = None, doc: str = "simple:retrieved") -> Retrieved:
    """Retrieval, assembly, and the trim to a budget in which relevance weighs importance: what is least relevant goes first.

    The chunks are as many as the options let through; everything after them is one small session."""
    chunks = retrieve_local(s, query, now, options)
    blocks = assembled(chunks, query, doc)
    items = trim.relevance_weighted(trim.decide(blocks), relevance_by_position(chunks, doc))
    fitted, report = trim.allocate(items, blocks, budget)
    small = trim.apply(blocks, fitted)
    count = lambda b: b.agg(F.coalesce(F.sum(estimate(F.col("text"))), F.lit(0)).alias("n"))
    tokens = count(blocks).select(F.col("n").alias("before")).crossJoin(F.broadcast(count(small).select(F.col("n").alias("after"))))  # one row each
    return Retrieved(chunks, blocks, small, report, tokens)


def handoff(s: Sessions, target: str, budget: int | None = None) -> dict[str, DataFrame]:
    """Sessions planned, trimmed to a budget of tokens each, and written in a target's native form; the source stays as it is."""
    items = trim.decide(s.blocks)
    fitted, _ = trim.allocate(items, s.blocks, budget)
    blocks = trim.apply(s.blocks, fitted).withColumn("msg_idx", F.col("new_idx").cast("int")).select(*c.BLOCK_TYPES)
    kept = Sessions(s.sessions.join(blocks.select("doc").distinct(), "doc", "left_semi"), blocks)
    if target in native.WRITERS:
        return native.native_tables(kept, target)
    return {"text": render.convert(kept, target)}

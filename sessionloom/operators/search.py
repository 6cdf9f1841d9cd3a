"""Filters, listing and search over sessions and lines."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_score
from ..functions.text import fold, fold_text, literal_find
from ..plans.canonical import DEFAULT_ORIGINS

EXACT = 1 << 16


@dataclass
class Query:
    """mode: substring or fuzzy; case: smart, sensitive or insensitive.  Filters that are None let all sessions through."""

    pattern: str
    mode: str = "substring"
    case: str = "insensitive"
    origins: list[str] = field(default_factory=lambda: list(DEFAULT_ORIGINS))
    harnesses: list[str] | None = None
    cwd: str | None = None
    branch: str | None = None
    model: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    limit: int | None = 20
    hits_per_doc: int | None = 8


def session_filter(q: Query) -> Column:
    """Metadata predicates, all of which reach the scan; null cwd, branch and model match no filter."""
    keep = F.lit(True)
    if q.harnesses:
        keep &= F.col("harness").isin(q.harnesses)
    if q.cwd is not None:
        base = q.cwd.rstrip("/")
        keep &= (F.col("cwd") == (base or "/")) | F.col("cwd").startswith(base + "/")
    if q.branch is not None:
        keep &= F.col("branch") == q.branch
    if q.model is not None:
        keep &= fold(F.col("model")).contains(fold_text(q.model))
    if q.since is not None:
        keep &= F.col("ts") >= F.lit(q.since)
    if q.until is not None:
        keep &= F.col("ts") <= F.lit(q.until)
    return keep


def list_sessions(sessions: DataFrame, q: Query, offset: int = 0) -> DataFrame:
    """Sessions, newest first; label: the title, else the cwd."""
    rows = sessions.where(session_filter(q)).withColumn("label", F.coalesce("title", "cwd"))
    rows = rows.orderBy(F.desc("ts"), "seq")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(q.limit) if q.limit is not None else rows


def score_lines(lines: DataFrame, q: Query) -> DataFrame:
    """Lines that match, with `score` and `at` (the first occurrence, null where only a fuzzy match is)."""
    rows = lines.where(F.col("origin").isin(q.origins))
    if q.mode == "fuzzy":
        return fuzzy_score(rows, q.pattern, q.case)
    at = literal_find(F.col("line"), q.pattern, q.case)
    rows = rows.withColumn("at", at).where("at is not null")
    return rows.withColumn("score", (F.lit(16 * len(q.pattern)) + F.when(F.expr("at = 0") | ~F.substr("line", F.col("at"), F.lit(1)).rlike(r"(?U)[\p{Alnum}_]"), 8).otherwise(0)).cast("long"))


def _transcript_order() -> list[Column]:
    return [F.col("msg_idx").asc_nulls_first(), F.col("block_idx"), F.col("line_idx")]


def search_docs(sessions: DataFrame, lines: DataFrame, q: Query) -> DataFrame:
    """doc, id, ts, seq, best and pos (0, 1, ...) of the best sessions: by best line, then newest, then first inserted.

    An empty pattern lists the newest sessions with a score of 0.  Only the ranked sessions, at most q.limit, get a place."""
    keep = sessions.where(session_filter(q)).select("doc", "id", "ts", "seq")
    if not q.pattern.strip():
        ranked = keep.withColumn("best", F.lit(0).cast("long"))
    else:
        best = score_lines(lines, q).groupBy("doc").agg(F.max("score").alias("best"))
        ranked = keep.join(best, "doc")
    ranked = ranked.orderBy(F.desc("best"), F.desc("ts"), "seq")
    if q.limit is None:
        return ranked
    return ranked.limit(q.limit).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("best"), F.desc("ts"), "seq")) - 1)


def search_hits(sessions: DataFrame, lines: DataFrame, q: Query) -> DataFrame:
    """The ranked sessions' best lines, in transcript order, with highlights: lines are looked at again only for them."""
    docs = search_docs(sessions, lines, q)
    if not q.pattern.strip():
        return docs.limit(0).select("doc", "id", F.lit(None).cast("int").alias("msg_idx"))
    hits = score_lines(lines.join(F.broadcast(docs.select("doc", "id", "pos")), "doc"), q)  # at most q.limit rows
    if q.hits_per_doc is not None:
        by_score = Window.partitionBy("doc").orderBy(F.desc("score"), *_transcript_order())
        hits = hits.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= q.hits_per_doc).drop("nth")
    span = F.when(F.col("at").isNotNull(), F.col("at") + len(q.pattern))
    return hits.withColumns({"from": F.col("at"), "to": span}).orderBy("pos", *_transcript_order())


def search_one(lines: DataFrame, q: Query) -> DataFrame:
    """Hits of one session in transcript order, the first q.limit of them; an empty pattern has none."""
    if not q.pattern.strip():
        return lines.limit(0)
    rows = score_lines(lines, q).orderBy(*_transcript_order())
    return rows.limit(q.limit) if q.limit is not None else rows


def index_stats(lines: DataFrame) -> DataFrame:
    """Documents, lines and characters of an index."""
    return lines.agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def resolve(sessions: DataFrame, wanted: str) -> DataFrame:
    """The session with this id or title, the newest of copies; else the one whose id starts so.

    matches: different ids that start so; more than one is an ambiguity for the caller to report."""
    exact = (F.col("id") == wanted) | (F.col("title") == wanted)
    rows = sessions.where(exact | F.col("id").startswith(wanted)).withColumn("exact", F.coalesce(exact, F.lit(False)))
    some = rows.agg(F.max("exact").alias("any"), F.countDistinct("id").alias("n"))
    best = rows.orderBy(F.desc("exact"), F.desc("ts"), "seq").limit(1)
    return best.crossJoin(F.broadcast(some)).select("doc", "id", "exact", F.when(F.col("any"), 1).otherwise(F.col("n")).cast("long").alias("matches"))

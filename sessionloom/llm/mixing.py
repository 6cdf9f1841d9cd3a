"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule: knots (time, weight) with straight lines between them, over training time 0 to 1.  The
integral of a schedule is the source's weight; the weights share out the words of the mix, no source beyond `limit` times
its size.  A source's cumulative demand follows its schedule; inverting it turns the place of a document in its source's
seeded order into a training position, and a range sort by position gives the mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

Schedule = Sequence[tuple[float, float]]
#: Rows of one source that one window partition holds, about.
ROWS_PER_BUCKET = 512


def curriculum(rank: int, weights: Sequence[float] = (3, 1, 2)) -> Schedule:
    """The schedule of the rank-th source: even ranks fade out, odd ranks fade in, around the weight of the rank."""
    w = weights[rank % len(weights)]
    return ((0.0, 1.5 * w), (1.0, 0.5 * w)) if rank % 2 == 0 else ((0.0, 0.5 * w), (1.0, 1.5 * w))


def integral(schedule: Schedule) -> np.ndarray:
    """The integral of the schedule from its start to each knot."""
    t, w = np.array(schedule, float).T
    return np.concatenate([[0.0], np.cumsum(np.diff(t) * (w[1:] + w[:-1]) / 2)])


def invert(schedule: Schedule, share: np.ndarray) -> np.ndarray:
    """The times at which the schedule has used `share` (0 to 1) of its integral."""
    t, w = np.array(schedule, float).T
    total = integral(schedule)
    x = np.clip(share, 0, 1) * total[-1]
    k = np.clip(np.searchsorted(total, x, "right") - 1, 0, len(t) - 2)
    x, length, a = x - total[k], t[k + 1] - t[k], w[k]
    slope = (w[k + 1] - a) / length
    root = np.sqrt(np.maximum(a * a + 2 * slope * x, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        step = np.where(a + root > 0, 2 * x / (a + root), 0)
    return t[k] + np.minimum(step, length)


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, limit: float) -> list[float]:
    """Targets by weight, each at most limit times its size; what is above goes to the others by weight again."""
    target, free, left = [0.0] * len(sizes), {i for i, (s, w) in enumerate(zip(sizes, weights, strict=True)) if s > 0 and w > 0}, float(total)
    while free:
        whole = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / whole >= limit * sizes[i]}
        if not full:
            for i in free:
                target[i] = left * weights[i] / whole
            break
        for i in full:
            target[i] = float(limit * sizes[i])
        left -= sum(target[i] for i in full)
        free -= full
    return target


def mix(docs: DataFrame, schedule: Callable[[int], Schedule] = curriculum, share: float = 1.5, limit: float = 2.0, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, source, size, source_size, target, taken, position and passes of each row.

    h: the document's seeded hash.  size: words of the text (null: 0).  passes: one struct for each time that the mix takes of
    the document, with words and position; taken: all those words; position: that of the first pass, null if there is none.
    Only the last document of a source's last pass may be taken in part, so a source's taken words are its target, rounded.

    Nulls: a null source is a source of its own, the last one; null texts and empty texts have size 0 and are never taken.
    Repeated rows and equal ids are taken one by one; their order among themselves doesn't show.  An empty table gives no
    rows.  The driver sees one row per source and no document.  Texts are read once and not shuffled.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    keyed, _ = materialize(keyed, "sizes")
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    sizes.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    schedules = [tuple(map(tuple, schedule(i))) for i in range(len(sizes))]
    weights = [float(integral(s)[-1]) for s in schedules]
    targets = share_out([r["source_size"] for r in sizes], weights, share * sum(r["source_size"] for r in sizes), limit)
    table = spark.createDataFrame([(i, r["source"], r["source_size"], t, round(t)) for i, (r, t) in enumerate(zip(sizes, targets, strict=True))], "rank int, s_source string, source_size long, target double, goal long")
    bits = max(0, int(np.ceil(np.log2(max([1, *(r["n"] for r in sizes)]) / ROWS_PER_BUCKET))))
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))

    offsets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, placed.source.eqNullSafe(offsets.o_source) & (placed.bucket == offsets.o_bucket))
    placed = placed.join(F.broadcast(table), placed.source.eqNullSafe(table.s_source))  # one row per source

    @F.pandas_udf("array<double>")
    def positions(rank: pd.Series, used: pd.Series) -> pd.Series:
        """The training positions at which the rank-th source has used these shares of its target."""
        sizes = used.map(len).to_numpy()
        flat = np.concatenate([*used.to_numpy(), np.zeros(0)])
        owner = np.repeat(rank.to_numpy(), sizes)
        out = np.empty(len(flat))
        for r in np.unique(owner):
            out[owner == r] = invert(schedules[r], flat[owner == r])
        return pd.Series(np.split(out, np.cumsum(sizes)[:-1]), index=rank.index)

    begin, size, goal, whole = F.col("start") + F.col("base"), F.col("size"), F.col("goal"), F.col("source_size")
    n = F.when(size > 0, F.greatest(F.lit(0), F.ceil((goal - begin) / F.greatest(whole, F.lit(1))))).otherwise(0).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    placed = placed.withColumn("words", F.transform(numbers, lambda p: F.least(size, goal - (begin + p * whole))))
    used = F.transform("words", lambda w, p: (begin + p * whole + w / 2) / goal)
    placed = placed.withColumn("at", positions("rank", used))
    passes = F.transform("words", lambda w, p: F.struct(w.alias("words"), F.get("at", p).alias("position")))
    taken = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select("doc_id", "h", "source", "size", "source_size", "target", taken.alias("taken"), F.get("at", F.lit(0)).alias("position"), passes.alias("passes"))


def mixed_documents(docs: DataFrame, seed: int = 17, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row of docs, with all columns, for each time that a document is taken, sorted by training position.

    A document that the end of its source's target cuts is given whole.  Documents that the mix doesn't take go.  Rows of one
    source, id and text are told apart by a hash of all their columns; those that are equal in all are interchangeable.  Null
    texts and texts without words are never taken; an empty table gives no rows."""
    placed = mix(docs, seed=seed, text=text, source=source, doc_id=doc_id, **options).where(F.size("passes") > 0)
    keys = ["doc_id", "source", "h"]
    order = Window.partitionBy(*keys)
    placed = placed.select(*keys, "passes").withColumn("nth", F.row_number().over(order.orderBy(F.col("passes")[0]["position"])))
    placed = placed.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("nth").alias("p_nth"), F.explode("passes.position").alias("at"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"))
    rows = rows.withColumn("nth", F.row_number().over(order.orderBy(F.xxhash64("doc"))))
    rows = rows.join(placed, rows.doc_id.eqNullSafe(placed.p_doc_id) & rows.source.eqNullSafe(placed.p_source) & (rows.h == placed.p_h) & (rows.nth == placed.p_nth))
    return rows.repartitionByRange("at", "h").sortWithinPartitions("at", "h").select("doc.*")

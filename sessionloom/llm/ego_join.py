"""Embedding near-dedup by the epsilon grid order join.

Vectors of length 1 at a cosine of c are sqrt(2 - 2c) apart: epsilon.  Projected on their leading principal dimensions they
are no further apart.  Sorted by the cells of a grid of that width, vectors are cut into blocks.  Intervals of the sequence
are joined recursively: a pair of intervals whose boxes are more than epsilon apart goes, any other is split, down to pairs of
blocks; a pair of blocks is split further in the same way, down to BASE vectors, whose cosines are computed.

Equal vectors are one vector with a weight.  What leaves a pair of blocks is a weight for each vector and a spanning forest
of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop, find_roots, materialize, spread_join

#: Dimensions of the grid, vectors of a block, children of an interval, vectors compared at once.
DIMENSIONS, BLOCK, FAN, BASE = 6, 1024, 8, 256
#: Blocks that are broadcast at once.
CHUNK = 64
FOUND = "node long, value long, edge boolean"
#: Vectors that the principal dimensions are fitted on at most; all vectors are indexed, and any dimensions give whole results.
FIT_ROWS = 10_000


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows made length 1.  The largest component comes to 1 first, so that no square is too large or too small."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _principal(sample: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading eigenvectors of the sample's second moments, as columns."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1][:, :dimensions])


def _axes(rows: DataFrame, seed: int = 9) -> dict[int, np.ndarray]:
    """Principal dimensions for each length of vector."""
    out = {}
    for (length,) in rows.select("length").distinct().collect():  # one row per length
        sample = rows.where(F.col("length") == length).orderBy(F.xxhash64(F.lit(seed), "embedding"), "embedding").limit(FIT_ROWS).select("embedding").toPandas()
        out[length] = _principal(_unit(np.array(sample["embedding"].tolist(), float)), min(DIMENSIONS, length))
    return out


def _place(axes: dict[int, np.ndarray], epsilon: float):
    """Adds projections (padded to DIMENSIONS) and grid cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            length = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1])
            out = np.zeros((batch.num_rows, DIMENSIONS))
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                raw = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                out[at, : axes[n].shape[1]] = _unit(raw) @ axes[n]
            cells = np.floor(out / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], [*batch.schema.names, "at", "cell"])

    return run


def _pairs(blocks: DataFrame, count: int, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, that are not provably distant: the recursion over intervals of the sequence."""
    levels = 0
    while FAN**levels < count:
        levels += 1

    def boxes(level: int) -> DataFrame:
        """Intervals of FAN**level blocks and their bounding boxes."""
        own = blocks.groupBy("length", F.floor(F.col("block") / FAN**level).alias("interval"))
        return own.agg(*[F.min(F.col("low")[k]).alias(f"l{k}") for k in range(DIMENSIONS)], *[F.max(F.col("high")[k]).alias(f"h{k}") for k in range(DIMENSIONS)])

    pairs = blocks.select("length").distinct().select("length", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        own = boxes(level)
        left = own.select(F.col("length").alias("ln"), F.floor(F.col("interval") / FAN).alias("pa"), F.col("interval").alias("na"), F.struct(*[c for c in own.columns if c[0] in "lh" and c[1:].isdigit()]).alias("box_a"))
        right = left.select(F.col("ln").alias("rn"), F.col("pa").alias("pb"), F.col("na").alias("nb"), F.col("box_a").alias("box_b"))
        gaps = [F.greatest(F.lit(0.0), F.col("box_b")[f"l{k}"] - F.col("box_a")[f"h{k}"], F.col("box_a")[f"l{k}"] - F.col("box_b")[f"h{k}"]) for k in range(DIMENSIONS)]
        far = sum((g * g for g in gaps), F.lit(0.0)) > epsilon * epsilon * (1 + 1e-9)
        pairs = pairs.join(left, (pairs.a == F.col("pa")) & (pairs.length == F.col("ln"))).join(right, (F.col("b") == F.col("pb")) & (F.col("length") == F.col("rn")))
        pairs = pairs.where((F.col("na") <= F.col("nb")) & ~far).select("length", F.col("na").alias("a"), F.col("nb").alias("b"))
    return pairs


class _Side:
    """The vectors of a block: ids, weights, unit vectors, projections."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.int64)
        raw = np.frombuffer(row["raw"], np.float32 if row["single"] else np.float64).astype(float).reshape(len(self.ids), -1)
        self.unit = _unit(raw)
        self.at = np.frombuffer(row["at"], np.float64).reshape(len(self.ids), -1)


def _join(a: _Side, b: _Side, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights linked to each vector of a and of b, and the stars of the links; a may be b."""
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    edges: list[np.ndarray] = []

    def base(i: int, j: int, k: int, m: int) -> None:
        hit = a.unit[i:j] @ b.unit[k:m].T >= cosine
        if a is b:
            hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
        if hit.any():
            na[i:j] += hit @ b.weights[k:m]
            nb[k:m] += a.weights[i:j] @ hit
            x, y = np.nonzero(hit)
            nodes, roots = find_roots(a.ids[i + x], b.ids[k + y])
            edges.append(np.stack([nodes, roots]))

    def recurse(i: int, j: int, k: int, m: int) -> None:
        if a is b and i > k:
            return
        gap = np.maximum(0, np.maximum(a.at[i:j].min(0) - b.at[k:m].max(0), b.at[k:m].min(0) - a.at[i:j].max(0)))
        if gap @ gap > epsilon * epsilon * (1 + 1e-9):
            return
        if max(j - i, m - k) <= BASE:
            base(i, j, k, m)
            return
        middle, centre = (i + j) // 2, (k + m) // 2
        for p, q in ((i, middle), (middle, j)) if j - i > BASE else ((i, j),):
            for r, s in ((k, centre), (centre, m)) if m - k > BASE else ((k, m),):
                recurse(p, q, r, s)

    recurse(0, len(a.ids), 0, len(b.ids))
    u, v = np.concatenate(edges, 1) if edges else np.zeros((2, 0), np.int64)
    u, v = find_roots(u, v) if len(u) else (u, v)
    return na, nb, u, v


def links(vectors: DataFrame, cosine: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (node, embedding, weight, length): linked weights (node, n), and edges (u, v).

    Nodes are distinct and not null, vectors of finite components that aren't all 0.  An empty table gives none of both."""
    epsilon = float(np.sqrt(2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    single = "float" in vectors.schema["embedding"].dataType.simpleString()
    axes = _axes(vectors)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = vectors.mapInArrow(_place(axes, epsilon), f"{fields}, at array<double>, cell array<int>")
    placed, placed_at = materialize(placed.repartitionByRange("length", "cell", "node").withColumn("part", F.spark_partition_id()), "grid")
    # Places in the sequence: a part's first place, from the counts of parts, and a row's place in its part.
    counts = placed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.ceil(F.col("n") / BLOCK).alias("k")).select("length", F.col("part").alias("p"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base")).withColumnRenamed("length", "l")
    inner = Window.partitionBy("length", "part").orderBy("cell", "node")
    rows = placed.withColumn("row", F.row_number().over(inner) - 1).join(counts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    rows = rows.withColumn("block", F.col("base") + F.floor(F.col("row") / BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        raw = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = table["at"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        one = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        return pa.table({"length": table["length"][:1], "block": table["block"][:1], "ids": one(table["node"].to_numpy()), "weights": one(table["weight"].to_numpy()), "raw": one(raw), "at": one(at), "single": pa.array([single]), "low": pa.array([at.min(0)], pa.list_(pa.float64())), "high": pa.array([at.max(0)], pa.list_(pa.float64()))})

    layout = "ids binary, weights binary, raw binary, at binary, single boolean"
    blocks = rows.select("length", "block", "row", "node", "weight", "embedding", "at").groupBy("length", "block").applyInArrow(pack, f"length int, block long, {layout}, low array<double>, high array<double>")
    blocks, blocks_at = materialize(blocks, "blocks")
    drop(vectors.sparkSession, placed_at)
    most = blocks.agg(F.max("block")).first()[0]
    pairs = _pairs(blocks.select("length", "block", "low", "high"), 1 if most is None else most + 1, epsilon)
    pairs, pairs_at = materialize(pairs, "block_pairs")
    a = blocks.select(F.col("length").alias("ln"), F.col("block").alias("a_"), F.struct("ids", "weights", "raw", "at", "single").alias("side_a"))
    b = blocks.select(F.col("length").alias("rn"), F.col("block").alias("b_"), F.struct("ids", "weights", "raw", "at", "single").alias("side_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = _Side(batch.column(2)[k].as_py())
                y = x if batch.column(0)[k] == batch.column(1)[k] else _Side(batch.column(3)[k].as_py())
                na, nb, u, v = _join(x, y, cosine, epsilon)
                some, other = na > 0, nb > 0
                nodes = np.concatenate([x.ids[some], y.ids[other], u])
                more = np.concatenate([na[some], nb[other], v])
                kind = np.concatenate([np.zeros(some.sum() + other.sum(), bool), np.ones(len(u), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(more), pa.array(kind)], ["node", "value", "edge"])

    # A block meets as many others as there are, so pairs of blocks with their vectors are no shuffle: CHUNK blocks at a time are
    # broadcast, and all others pass by them where they are read.
    found = None
    for first in range(0, 0 if most is None else most + 1, CHUNK):
        own = pairs.where(F.col("b").between(first, first + CHUNK - 1))
        both = a.join(F.broadcast(own), (F.col("a") == F.col("a_")) & (F.col("length") == F.col("ln")))
        both = both.join(F.broadcast(b.where(F.col("b_").between(first, first + CHUNK - 1))), (F.col("b") == F.col("b_")) & (F.col("length") == F.col("rn")))
        part, _ = materialize(both.select("a", "b", "side_a", "side_b").mapInArrow(run, FOUND), "pairs")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    drop(vectors.sparkSession, blocks_at, pairs_at)
    counts = found.where("not edge").groupBy("node").agg(F.sum("value").alias("n"))
    return counts, found.where("edge").select(F.col("node").alias("u"), F.col("value").alias("v"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, nor do vectors of different
    lengths.  Each row is a vector of its own, repeated rows and equal ids too; a null id is a component's id only if all its
    ids are null.  An empty table gives no rows.  Other columns are not read."""
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.withColumn("ok", F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False)))
    classes = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes, classes_at = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "embedding", "weight", F.size("embedding").alias("length"), "least"), "vectors")
    counts, edges = links(classes.select("node", "embedding", "weight", "length"), cosine)
    nodes = components(edges).withColumnRenamed("node", "m")
    own = classes.join(counts, "node", "left").join(nodes, F.col("node") == F.col("m"), "left").select("embedding", "least", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    own, _ = materialize(own, "labelled")
    drop(vectors.sparkSession, classes_at)
    lowest = own.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    own = spread_join(own, lowest, ["root"]).select(F.col("embedding").alias("key"), "n_links", "component", F.col("weight").alias("n"))
    known = spread_join(rows.where("ok").withColumnRenamed("embedding", "key"), own, ["key"]).select("vec_id", "ok", "n_links", "component")
    out = known.unionByName(rows.where("not ok").select("vec_id", "ok", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")))
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

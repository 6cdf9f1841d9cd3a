"""What the operators of this subpackage share: tables in the shared folder, text slices, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session has none (tests in local mode), a temporary folder of this process."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or _LOCAL.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tables-")
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no table has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once as Parquet in the shared folder and returns it reread, with its path.

    This cuts the lineage: a lost executor costs no earlier stage, and nothing is computed twice."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    for made in _SCOPES[-1:]:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_SCOPES: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that materialize() makes inside, on leaving, but for those that are taken out of the list.

    A result that is read later still needs its tables: only what has been written or collected inside may be used after."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        drop(spark, *made)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of materialize() that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size of df in bytes: of the files, for a scan.  It reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per_bucket: int, least: int = 1, most: int = 1 << 20) -> int:
    """How many buckets of per_bucket bytes df needs."""
    return int(min(most, max(least, -(-planned_bytes(df) // per_bucket))))


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows of about limit bytes; a longer text is a run of its own.  Null: empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """Each row's UTF-8 bytes, one at a time; None for null."""
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.large_binary()))


def release() -> None:
    """Gives memory that this Python worker no longer uses back to the system: workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def find_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the smallest node of the component of each, by min-label hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, batch by batch, as stars: at most one row per node of a batch."""
    for batch in batches:
        if batch.num_rows:
            nodes, roots = find_roots(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
            other = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], ["u", "v"])


def spread_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left and right joined by key (no nulls); right has one row for each key, with n, how many rows of left have it.

    Keys of a thousandth of these rows or more are a thousand at most: their rows of right are broadcast, so no task gets
    all rows of such a key.  The others meet by shuffle."""
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(right.where(F.col("n") * 1000 >= total).drop("n"))
    rest = right.where(F.col("n") * 1000 < total).drop("n")
    return left.join(hot, key).unionByName(left.join(hot.select(*key), key, "left_anti").join(rest, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v), both long; root: the smallest node of its component.

    Large-star and small-star rounds (Kiveris et al. 2014) until a round changes nothing.  Each round is written to the
    shared folder.  A node with very many edges is no single task: minima are aggregated before they are joined, and the
    minima of such nodes are broadcast."""
    spark = edges.sparkSession
    edges = edges.where("u <> v").mapInArrow(_contract, "u long, v long").distinct()
    edges, path = materialize(edges, "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
        large, large_at = materialize(spread_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after, new = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        drop(spark, path, large_at)
        edges, path = after, new
        if (mark := _mark(edges)) == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, str]:
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, str(total)

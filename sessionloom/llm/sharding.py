"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows into buckets of memory size by a seeded hash.  Pass 2 takes one bucket at a time, puts it into an
order that doesn't depend on where its rows came from, runs a Fisher-Yates shuffle seeded by the bucket's number, numbers
its rows after those of all earlier buckets and writes them.  Shards are equal stretches of these numbers, so a bucket is
written to one shard, or to two where a stretch ends in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize


def fisher_yates(n: int, seed: int, bucket: int, part: int = 0) -> np.ndarray:
    """A permutation of 0 .. n-1; numpy's shuffle is Fisher and Yates's."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket, part])).shuffle(order)
    return order


def shuffled(docs: DataFrame, key: list[Column], rows_per_bucket: int, seed: int) -> tuple[DataFrame, int, str]:
    """docs with `place`, a row's place in the shuffled whole: 0, 1, ... without gaps; the number of rows; and the path of a
    table that can go once the first is written.

    key: what rows scatter and are sorted by.  A bucket that equal keys make larger than twice rows_per_bucket is scattered
    further by row numbers, so no task gets more than that however many rows are equal.  The rows are read once and written
    with their buckets and numbers, so that counts and rows agree whatever happens to the input or to an executor."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.struct(*key).alias("_key"))
    rows = rows.withColumns({"_hash": F.xxhash64(F.lit(seed), "_key"), "_row": F.monotonically_increasing_id()})
    rows, path = materialize(rows, "scattered")
    n = rows.count()
    n_buckets = max(1, -(-n // rows_per_bucket))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)))
    heavy = rows.groupBy("_bucket").count().where(F.col("count") > 2 * rows_per_bucket + 64)
    heavy = heavy.select("_bucket", F.ceil(F.col("count") / rows_per_bucket).cast("long").alias("_parts"))
    # Broadcast: the texts must not be shuffled for it.  Heavy buckets hold over twice rows_per_bucket, so they are few.
    rows = rows.join(F.broadcast(heavy), "_bucket", "left")
    rows = rows.withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("_row"), F.col("_parts")))).drop("_parts", "_row", "_hash")
    counts = rows.groupBy("_bucket", "_part").agg(F.count("*").alias("_n"))
    # One row per bucket, so rows / rows_per_bucket of them: sums by group of buckets first, then within each group.
    counts = counts.withColumn("_group", F.floor(F.col("_bucket") / 4096))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_g"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_gbase"))
    inner = Window.partitionBy("_group").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(groups, "_group")
    base = counts.select(F.col("_bucket").alias("_b"), F.col("_part").alias("_p"), (F.col("_gbase") + F.col("_in")).alias("_base"))
    rows = rows.join(base, (F.col("_bucket") == F.col("_b")) & (F.col("_part") == F.col("_p"))).drop("_b", "_p")

    def place(rows: pa.Table) -> pa.Table:
        bucket, part, first = (rows[c][0].as_py() for c in ("_bucket", "_part", "_base"))
        keys = rows["_key"].combine_chunks().flatten()
        order = pc.sort_indices(pa.table(keys, names=[f"k{i}" for i in range(len(keys))]), [(f"k{i}", "ascending") for i in range(len(keys))])
        out = rows.select(names).take(order.take(pa.array(fisher_yates(len(rows), seed, bucket, part))))
        return out.append_column("place", pa.array(np.arange(first, first + len(out))))

    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)], T.StructField("place", T.LongType())])
    out = rows.groupBy("_bucket", "_part").applyInArrow(place, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], F.col("place").alias("place")), n, path


def _octets(text: str) -> Column:
    return F.col(f"`{text}`").cast("binary")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 23, rows_per_bucket: int = 8192, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes docs as Parquet folders shard=0 .. under path, with `slot`, and returns them reread.

    Law `rows`: shards' counts differ by one at most; slots are 0, 1, ... in each shard.  A shard's files are its buckets, each
    in the order of its slots: neither a task nor a file holds a whole shard.  Null ids, null texts, repeated ids and repeated
    rows get a place each.  Equal texts have no common shard: a group of a third of all rows could not keep the law.  Groups
    that stay whole are the rows of one bucket, of equal id and text hash, as long as these are no more than two buckets hold.
    Columns of docs named shard, slot or place would clash with ours: they must be renamed first, or ValueError is raised.  An
    empty table leaves a table without rows."""
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column that is named shard or slot")
    key = [F.col(f"`{doc_id}`").alias("a"), F.coalesce(F.crc32(_octets(text)), F.lit(-1)).alias("b"), F.coalesce(F.octet_length(_octets(text)), F.lit(-1)).alias("c")]
    placed, n, scattered = shuffled(docs, key, rows_per_bucket, seed)
    least, more = n // shards, n % shards
    p, edge = F.col("place"), more * (least + 1)
    own = {"shard": F.when(p < edge, F.floor(p / (least + 1))).otherwise(more + F.floor((p - edge) / max(least, 1))).cast("int"), "slot": F.when(p < edge, p % (least + 1)).otherwise((p - edge) % max(least, 1)).cast("long")}
    placed = placed.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(k) for k, c in own.items()])
    placed.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    drop(docs.sparkSession, scattered)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def shard(docs: DataFrame, path: str, shards: int = 16, seed: int = 23, rows_per_bucket: int = 8192, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, from the shards that write_shards() has written.

    size: UTF-8 bytes of the text plus 1 (null: 1); text_crc32 of a null text is that of no bytes, 0."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    written = write_shards(own, path, shards, seed, rows_per_bucket)
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

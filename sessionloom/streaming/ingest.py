"""Incremental ingest with Structured Streaming: new files' sessions replace those of the same key.

A table is target/v=N/b=K: batch N writes those of its buckets of keys in which something changed, whole.  A bucket's content
is its highest version; a batch that runs again after a failure writes the same version over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import upsert

BUCKETS = 64


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(name[len(prefix) :]) for name in found if name.startswith(prefix))


def versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """The highest version, under a bound, of each bucket."""
    out: dict[int, int] = {}
    for v in _children(spark, target, "v="):
        if below is None or v < below:
            out.update(dict.fromkeys(_children(spark, f"{target}/v={v}", "b="), v))
    return out


def upsert_stream(rows: DataFrame, target: str, keys: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts a stream of rows into the table; a batch reads and writes only the buckets that it touches."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.b for r in batch.select("b").distinct().collect()]  # at most `buckets`
        old = versions(spark, target, number)
        paths = [f"{target}/v={old[b]}/b={b}" for b in touched if b in old]
        before = spark.read.schema(batch.drop("b").schema).parquet(*paths) if paths else batch.drop("b").limit(0)
        before = before.withColumn("b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        upsert(before, batch, keys).write.mode("overwrite").partitionBy("b").parquet(f"{target}/v={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table as the last batch left it."""
    return spark.read.parquet(*[f"{target}/v={v}/b={b}" for b, v in versions(spark, target).items()])


def text_stream(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines of new files under path, with their file, parsed."""
    lines = spark.readStream.format("text").load(path)
    return parse(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value")))

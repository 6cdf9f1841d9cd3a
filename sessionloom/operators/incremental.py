"""Change cursors, the extraction cache, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_cursor(*columns: Column) -> Column:
    """A hash of what a session holds, as text; an empty cursor means unknown."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def latest_cursor(rows: DataFrame, key: str, time: str) -> DataFrame:
    """(key, cursor): the newest time of each key."""
    return rows.groupBy(key).agg(F.max(time).cast("string").alias("cursor"))


def file_cursors(spark, path: str, **options) -> DataFrame:
    """(file, cursor): modification time in nanoseconds and length of each file; contents aren't read."""
    files = spark.read.format("binaryFile").options(**options).load(path).select("path", "modificationTime", "length")
    return files.select(F.col("path").alias("file"), F.concat((F.unix_micros("modificationTime") * 1000).cast("string"), F.lit(":"), F.col("length").cast("string")).alias("cursor"))


def cache_hits(live: DataFrame, cache: DataFrame) -> DataFrame:
    """Live sessions (doc, cursor) whose cached row has the same cursor; an empty cursor never matches."""
    return live.where("cursor <> ''").join(cache, ["doc", "cursor"], "left_semi")


def cache_misses(live: DataFrame, cache: DataFrame) -> DataFrame:
    return live.join(cache.where("cursor <> ''"), ["doc", "cursor"], "left_anti")


def prune(cache: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows of sessions that still are there."""
    return cache.join(live.select("doc").distinct(), "doc", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key.  Of new's own repeats the last stays: the one with the greatest
    value of the column `order`; without one, the greatest in all its columns, so that reruns agree."""
    rest = [x for x in new.columns if x not in keys]
    last = F.struct(*([F.col(order).alias("_o")] if order else []), *rest)
    fresh = new.groupBy(*keys).agg(F.max(last).alias("_last")).select(*[F.col(x) if x in keys else F.col(f"_last.{x}") for x in new.columns])
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def remove(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def dedup_events(rows: DataFrame, key: str, body: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with each key once, and the keys whose repeats differ (not empty is an error)."""
    marks = rows.groupBy(key).agg(F.count_distinct(F.xxhash64(*body)).alias("n")).where("n > 1").select(key)
    return rows.dropDuplicates([key]), marks

"""What adapters share: native rows in, canonical sessions and blocks out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json as J
from ..plans import canonical as c


@dataclass
class Sessions:
    """Canonical tables of a source."""

    sessions: DataFrame
    blocks: DataFrame

    def lines(self) -> DataFrame:
        return c.lines(self.sessions, self.blocks)


Adapter = Callable[..., Sessions]
#: Adapters by harness.
ADAPTERS: dict[str, Adapter] = {}


def adapter(name: str):
    def register(f: Adapter) -> Adapter:
        ADAPTERS[name] = f
        return f

    return register


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, stem, line_no, v): lines of all files under path that are JSON; blank and other lines are left out.

    A file's lines are numbered where it is read: files are not split, so no line moves for its number."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parsed(rows)


def parsed(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) with the id from the file's name and the parsed value."""
    rows = lines.withColumn("v", J.parse(F.col("line"))).where("v is not null")
    stem = F.regexp_extract("file", r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)
    return rows.select("file", stem.alias("stem"), "line_no", "v")


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, stem, v): whole files that are JSON."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("line_no"), F.col("value").alias("line"))
    return parsed(rows).drop("line_no")


def first_value(value: Column, order: Column, where: Column | None = None) -> Column:
    """The first value that isn't null, in order, as an aggregate."""
    there = value.isNotNull() if where is None else value.isNotNull() & where
    return F.min(F.when(there, F.struct(order.alias("o"), value.alias("x"))))["x"]


def last_value(value: Column, order: Column, where: Column | None = None) -> Column:
    there = value.isNotNull() if where is None else value.isNotNull() & where
    return F.max(F.when(there, F.struct(order.alias("o"), value.alias("x"))))["x"]


def number_messages(rows: DataFrame, order: list[str], block: str) -> DataFrame:
    """msg_idx: 0, 1, ... of the different values of order in each doc; block_idx likewise within a message."""
    by_doc = Window.partitionBy("doc").orderBy(*order)
    rows = rows.withColumn("msg_idx", (F.dense_rank().over(by_doc) - 1).cast("int"))
    return rows.withColumn("block_idx", (F.row_number().over(Window.partitionBy("doc", "msg_idx").orderBy(block)) - 1).cast("int"))


def block_table(rows: DataFrame) -> DataFrame:
    """The canonical columns of rows, those that it lacks null."""
    return c.blocks(rows, **{k: F.col(k) for k in c.BLOCK_TYPES if k in rows.columns})


def carried(ts: Column, order: list[str]) -> Column:
    """The last timestamp up to a row of its doc."""
    return F.last(ts, ignorenulls=True).over(Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def discover(stores: dict[str, Sessions], harnesses: list[str] | None = None) -> DataFrame:
    """Sessions of all stores, newest first; only the named harnesses' stores are looked at, if any is named."""
    wanted = [J.harness(h) for h in harnesses] if harnesses else list(stores)
    tables = [stores[h].sessions for h in wanted if h in stores]
    if not tables:
        raise ValueError(f"no store of {', '.join(wanted) or 'any harness'}")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy(F.desc("ts"), "doc")


def teammate_lineage(sessions: DataFrame, prefix: str = "team_prefix") -> DataFrame:
    """(doc, parent): the one other session whose id starts with a session's eight hex digits; more than one is none."""
    named = sessions.where(F.col(prefix).isNotNull()).select("doc", F.lower(prefix).alias("p"))
    others = sessions.select(F.col("doc").alias("other"), F.col("id").alias("parent"), F.lower(F.substring("id", 1, 8)).alias("p"))
    rows = named.join(others, "p").where("doc <> other")
    return rows.groupBy("doc").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).where("n = 1").drop("n")


def active_path(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc, node, pos) from root to leaf of each doc's tree; nodes: doc, node, parent; leaves: doc, leaf.

    A cycle, a missing leaf or a missing parent, or no leaf at all: no rows for that doc, and the caller falls back.  A doc's
    tree is held as a map and walked by a fold, in Spark's own functions: one shuffle whatever the depth."""
    hops = nodes.select("doc", "node", F.when(F.col("parent") != "", F.col("parent")).alias("parent"))
    known = hops.select("doc", F.col("node").alias("parent"), F.lit(True).alias("known"))
    hops = hops.join(known, ["doc", "parent"], "left").select("doc", "node", "parent", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("broken"))
    held = hops.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("parent", "broken")))).alias("m"), F.count("*").alias("n"))

    def walk(m: Column, leaf: Column, n: Column) -> Column:
        zero = F.struct(leaf.alias("at"), F.array().cast("array<string>").alias("path"), F.lit(False).alias("bad"))

        def step(a, _):
            here = F.try_element_at(m, a["at"])
            on = a["at"].isNotNull() & ~a["bad"]
            bad = a["bad"] | (a["at"].isNotNull() & (here.isNull() | here["broken"]))
            return F.when(on, F.struct(F.when(~bad, here["parent"]).alias("at"), F.when(bad, a["path"]).otherwise(F.array_append(a["path"], a["at"])).alias("path"), bad.alias("bad"))).otherwise(a)

        return F.aggregate(F.sequence(F.lit(0), n.cast("int")), zero, step)

    rows = held.join(leaves, "doc").withColumn("w", walk(F.col("m"), F.col("leaf"), F.col("n")))
    good = rows.where("not w.bad and w.at is null and size(w.path) > 0 and size(array_distinct(w.path)) = size(w.path)")
    return good.select("doc", F.posexplode(F.reverse("w.path")).alias("pos", "node"))

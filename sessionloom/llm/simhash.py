"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments.  Each distinct fingerprint goes into one table per segment and fetches matches by the
Hamming ball of radius 1 of its own segment: the segment itself, and the segment with one of its zero bits set (of two
segments that differ in one bit, the one with the zero fetches the other).  Whole distances decide on what is fetched.
With 64 bits in two segments of 32 and a distance of 3 nothing is missed: three differing bits leave one segment with at
most one.  With 320 bits in 16 segments of 20 neighbouring bits and 16 of every 16th bit, for similar texts, a pair at
distance p * 320 is fetched with a probability of about 1 - (1 - (1-p)**20 - 20 * p * (1-p)**19)**32: 0.997 at a shingle
similarity of 0.8.  What is fetched for a similarity is decided by the shingles themselves.

Equal fingerprints are one node throughout, so copies never meet as pairs, and each task hands on a spanning forest of the
links it finds, never all the links of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, drop, find_roots, materialize, release, spread_join, text_bytes

SEED = 42
#: Fingerprints of one segment value that are compared with as many others at once.
BLOCK = 512
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _more_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """n words of 64 bits for each hash: the hash, then values mixed from it."""
    out = np.empty((len(hashes), n), np.uint64)
    out[:, 0] = hashes
    for k in range(1, n):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of a whole text's shingles of `words` words, repeats included; of a shorter text, the hash of all of it."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes | None, words: int, bits: int = 64) -> bytes:
    """The fingerprint, little endian, of a whole text's shingles of `words` words, repeats included; without words, zero."""
    return _majority(shingles(text, words), bits)


def _majority(hashes: np.ndarray, bits: int) -> bytes:
    """A bit is 1 if it is 1 in more than half of the hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    n = len(hashes)
    octets = _more_words(hashes, bits // 64).view(np.uint8)
    total = np.zeros(bits, np.int64)
    for at in range(0, n, 255 * 64):
        part = np.unpackbits(octets[at : at + 255 * 64], axis=1, bitorder="little")
        whole = len(part) // 255 * 255
        total += np.add.reduce(part[:whole].reshape(-1, 255, bits), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += np.add.reduce(part[whole:], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n, bitorder="little").tobytes()


def fingerprints(docs: DataFrame, words: int, bits: int, text: str = "text", doc_id: str = "doc_id", distinct: bool = False) -> DataFrame:
    """doc_id, text_hash and fp of each row; with distinct, fp without repeats of shingles, and a hash of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, every = [], []
            for t in text_bytes(batch.column(2)):
                found = shingles(t, words)
                if distinct:
                    found = np.unique(found)
                    every.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                fp.append(_majority(found, bits))
            more = [pa.array(np.array(every, np.uint64).view(np.int64))] if distinct else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.binary()), *more], ["doc_id", "text_hash", "fp", "shingles"][: 3 + len(more)])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.BinaryType())])
    if distinct:
        schema = schema.add("shingles", T.LongType())
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInArrow(run, schema)


def _words(column: pa.Array) -> np.ndarray:
    """The fingerprints of a column as rows of 64-bit words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column[0].as_py()) // 8
    return np.frombuffer(column.buffers()[2], np.uint64, n * len(column), np.frombuffer(column.buffers()[1], np.int32)[column.offset]).reshape(-1, n)


def _binary(words: np.ndarray) -> pa.Array:
    width = words.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.arange(0, width * len(words) + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(words))])


def _balls(segment: int, both: bool = False):
    """(key, node, fp, probe): a fingerprint's rows in the tables of its segments, and the probes of its balls; then the other
    columns.  With both, segments are made of neighbouring bits and, once more, of bits far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.uint64(1) << np.arange(segment, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                node, fp = rows.column(0).to_numpy(zero_copy_only=False), _words(rows.column(1))
                flat = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little").reshape(len(fp), -1, segment)
                if both:
                    flat = np.concatenate([flat, flat.reshape(len(fp), segment, -1).transpose(0, 2, 1)], axis=1)
                own = (flat.astype(np.uint64) * bit).sum(axis=2, dtype=np.uint64)  # a row for each fingerprint, a column for each segment
                row, seg, zero = np.nonzero(flat == 0)
                table = np.arange(own.shape[1], dtype=np.uint64) << np.uint64(segment)
                key = np.concatenate([(own | table).ravel(), own[row, seg] | table[seg] | bit[zero]])
                who = np.concatenate([np.repeat(np.arange(len(fp)), own.shape[1]), row])
                order = np.argsort(who, kind="stable")  # rows of one fingerprint side by side compress
                key, who = key[order], who[order]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[who]), _binary(fp[who]), pa.array(order >= own.size), *(c.take(pa.array(who)) for c in rows.columns[2:])], ["key", "node", "fp", "probe", *rows.schema.names[2:]])

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words, over the last axis."""
    return sum(np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int16) for k in range(a.shape[-1]))


def _near(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The stars of the links between a and b, compared block by block."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = np.nonzero(_distances(a[i : i + BLOCK, None], b[None, j : j + BLOCK]) <= distance)
            if len(x):
                u, v = find_roots(np.concatenate([u, na[i + x]]), np.concatenate([v, nb[j + y]]))
    return u, v


def _dense(key: int, segment: int, table: np.ndarray, nt: np.ndarray, probe: np.ndarray, np_: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As _near, for many fingerprints of one segment value.  If fewer bits may differ than the rest of a fingerprint has
    octets, an octet of the rest is equal, so only fingerprints with an equal octet are compared."""
    own = key >> segment
    octets = [] if (own + 1) * segment > table.shape[1] * 64 else [k for k in range(table.shape[1] * 8) if 8 * k + 8 <= own * segment or 8 * k >= (own + 1) * segment]
    if len(table) * len(probe) <= 16 * BLOCK * BLOCK or len(octets) <= distance:
        return _near(table, nt, probe, np_, distance)
    a, b, u, v = table.view(np.uint8), probe.view(np.uint8), [], []
    for k in octets[: distance + 1]:
        for value in np.intersect1d(a[:, k], b[:, k]):
            s, t = a[:, k] == value, b[:, k] == value
            x, y = _near(table[s], nt[s], probe[t], np_[t], distance)
            u.append(x)
            v.append(y)
    return (np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2


def _verify(segment: int, distance: int):
    """Links among rows sorted by key, as stars."""

    def found(key: np.ndarray, node: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        tables = np.add.reduceat((~probe).astype(np.int64), first)
        u, v = [], []
        small = (tables > 0) & (size > 1) & (size <= 64)
        for n in np.unique(size[small]):  # all keys of n rows at once
            groups = first[small & (size == n)][:, None] + np.arange(n)
            step = max(1, 200_000 // int(n * n))
            for k in range(0, len(groups), step):
                at = groups[k : k + step]
                g, i, j = np.nonzero((_distances(fp[at][:, :, None], fp[at][:, None, :]) <= distance) & ~probe[at][:, :, None])
                u.append(node[at[g, i]])
                v.append(node[at[g, j]])
        for k in np.flatnonzero((tables > 0) & (size > 64)):
            at = slice(first[k], first[k] + size[k])
            held = ~probe[at]
            x, y = _dense(int(key[first[k]]), segment, np.ascontiguousarray(fp[at][held]), node[at][held], np.ascontiguousarray(fp[at]), node[at], distance)
            u.append(x)
            v.append(y)
        if not u:
            return (np.zeros(0, np.int64),) * 2
        a, b = np.concatenate(u), np.concatenate(v)
        return find_roots(a[a != b], b[a != b])

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        u, v = found(rows["key"].to_numpy(), rows["node"].to_numpy(), _words(rows["fp"]), rows["probe"].to_numpy())
        if (u != v).any():
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return _by_key(run)


def _by_key(of_rows):
    """of_rows over rows sorted by key.  A key may run over several batches; only its rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            yield from of_rows(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy(zero_copy_only=False)
            if held and held[-1].column("key")[-1].as_py() != key[0]:
                yield from flush()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                held.append(batch.slice(0, cut))
                yield from flush()
            held.append(batch.slice(cut))
        if held:
            yield from flush()
        release()

    return run


def links(distinct: DataFrame, segment: int, distance: int, both: bool = False) -> DataFrame:
    """Edges (u, v) between nodes, with the components of all links among distinct (node, fp)."""
    rows = distinct.select("node", "fp").mapInArrow(_balls(segment, both), "key long, node long, fp binary, probe boolean")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(segment, distance), "u long, v long")


def _shingle_sets(docs: DataFrame, nodes: DataFrame, words: int, text: str) -> DataFrame:
    """(node, shingles, size): the distinct shingles' hashes of the nodes (node, text_hash), from one of each one's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingles(t, words)).view(np.int64) for t in text_bytes(part.column(1))]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends))], ["node", "shingles", "size"])
        release()

    rows = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(nodes, "text_hash")
    return rows.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, shingles array<long>, size int")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets of shingles have that Jaccard similarity at least.  Sizes alone decide first."""
    sizes = sets.select("node", "size")
    near = pairs.join(sizes.toDF("u", "m"), "u").join(sizes.toDF("v", "n"), "v").where(F.least("m", "n") >= similarity * F.greatest("m", "n"))
    rows = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return rows.where(both >= similarity * (F.col("m") + F.col("n") - both)).select("u", "v")


#: Documents and shingles of a tile at most; shingles of more of a tile's documents than RARE are counted by matrix products.
TILE, TILE_SHINGLES, RARE = 1024, 1 << 20, 16
#: Documents of a group whose links are held at once.
STRIPE = 128


def _common(sets: pa.ListArray) -> np.ndarray:
    """How many elements each two of the sets have in common: [i, j] for i < j, as 32-bit floats, exact below 2**24."""
    n = len(sets)
    flat, row = sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), sets.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate([flat[:1] == flat[:1], flat[1:] != flat[:-1]]))
    times = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.float32)
    for c in range(2, min(RARE, n) + 1):
        x, y = np.triu_indices(c, 1)
        own = first[times == c]
        step = max(1, 500_000 // len(x))
        for k in range(0, len(own), step):
            who = row[own[k : k + step, None] + np.arange(c)]
            np.add.at(out.ravel(), (who[:, x] * n + who[:, y]).ravel(), np.float32(1))
    often = np.flatnonzero(times > RARE)
    for k in range(0, len(often), 1024):
        own = often[k : k + 1024]
        column = np.repeat(np.arange(len(own)), times[own])
        at = np.repeat(first[own] - np.cumsum(times[own]) + times[own], times[own]) + np.arange(len(column))
        has = np.zeros((n, len(own)), np.float32)
        has[row[at], column] = 1
        for i in range(0, n, STRIPE):
            out[i : i + STRIPE, i:] += has[i : i + STRIPE] @ has[i:].T
    return out


def _within(similarity: float):
    """The links of a group of documents as stars: each two sets are compared, only a spanning forest leaves.

    Beside the counts, only the links of a stripe of documents are held at a time."""

    def run(rows: pa.Table) -> pa.Table:
        u = v = np.zeros(0, np.int64)
        if len(rows["label"].unique()) > 1:
            node, size = rows["node"].to_numpy(), rows["size"].to_numpy().astype(float)
            both = _common(rows["shingles"].combine_chunks())
            for i in range(0, len(node), STRIPE):
                own, least = both[i : i + STRIPE, i:].astype(float), size[i : i + STRIPE, None]
                x, y = np.nonzero(np.triu(own >= similarity * (least + size[None, i:] - own), 1))
                if len(x):
                    u, v = find_roots(np.concatenate([u, node[i + x]]), np.concatenate([v, node[i + y]]))
            if len(node) > STRIPE:
                del both
                release()
        return pa.table({"u": u[u != v], "v": v[u != v]})

    return run


def _across(parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Stars (u, v) of all links between nodes of one root: parts has (node, root, label), sets as of _shingle_sets().

    Linked sets have sizes of one class or of neighbouring ones.  A class of a root is dealt out in tiles, and each two tiles
    of one class or of neighbouring classes meet in a task: no pair of documents is ever a row."""
    width = float(-np.log(similarity)) * (1 + 1e-9)
    rows = parts.join(sets.select("node", "size").where("size > 0"), "node").withColumn("class", F.floor(F.log("size") / width))
    rows, _ = materialize(rows.select("node", "root", "label", "size", "class"), "open")
    counts = rows.groupBy("root", "class").agg(F.count("*").alias("n"), F.max("size").alias("most"))
    counts = counts.withColumn("tiles", F.ceil(F.greatest(F.col("n") / TILE, F.col("n") * F.col("most") / TILE_SHINGLES)).cast("long"))
    order = Window.partitionBy("root").orderBy("class")
    beside = lambda f, step: F.coalesce(F.when(f("class", 1).over(order) == F.col("class") + step, f("tiles", 1).over(order)), F.lit(0))
    counts, _ = materialize(counts.select("root", "class", "n", "tiles", beside(F.lead, 1).alias("up"), beside(F.lag, -1).alias("down")), "tiles")
    rows = spread_join(rows, counts, ["root", "class"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))

    def keys(n: str, of) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), of)).otherwise(F.array())

    group = lambda c, kind, a, b: F.struct(c.cast("long").alias("c"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    c, tile = F.col("class"), F.col("tile")
    own = F.when((F.col("tiles") > 1) | (F.col("up") + F.col("down") == 0), keys("tiles", lambda k: group(c, 0, F.least(tile, k), F.greatest(tile, k)))).otherwise(F.array())
    every = F.concat(own, keys("up", lambda k: group(c, 1, tile, k)), keys("down", lambda k: group(c - 1, 1, k, tile)))
    dealt = rows.select("node", "root", "label", F.explode(every).alias("g")).select("node", "label", "root", "g.*")
    dealt = dealt.join(sets, "node").select("root", "c", "kind", "a", "b", "node", "label", "size", "shingles")
    return dealt.groupBy("root", "c", "kind", "a", "b").applyInArrow(_within(similarity), "u long, v long")


def _similar_components(docs: DataFrame, groups: DataFrame, segment: int, distance: int, words: int, similarity: float, text: str) -> DataFrame:
    """(node, root) of the components of all pairs that have the similarity and whose fingerprints links join.

    First the spanning forests of the fetched pairs are verified.  Where that leaves parts of one forest apart, all its
    documents are compared, tile by tile."""
    near, _ = materialize(links(groups, segment, distance, True).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near")
    whole, _ = materialize(components(near), "whole")
    sets, _ = materialize(_shingle_sets(docs, groups.join(whole, "node").select("node", "text_hash"), words, text), "sets")
    linked, _ = materialize(_similar(near, sets, similarity), "linked")
    parts = whole.join(components(linked).withColumnRenamed("root", "part"), "node", "left").withColumn("label", F.coalesce("part", "node"))
    parts, _ = materialize(parts.select("node", "root", "label"), "parts")
    split = parts.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("root")
    found, _ = materialize(_across(parts.join(split, "root").select("node", "root", "label"), sets, similarity), "across")
    return components(linked.unionByName(found))


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 320, segment: int = 20, distance: int = 55, text: str = "text", doc_id: str = "doc_id", similarity: float | None = None) -> DataFrame:
    """doc_id, text_hash, fingerprint, component_id and kept of each row.

    Fingerprints within the distance link.  With a similarity, such pairs are candidates, and those link whose sets of
    shingles have that Jaccard similarity.  component_id: the smallest id that links reach, the row's own included;
    kept: the row has that id.  Texts that are null, empty or white space have fingerprint zero and link like others.
    Repeated rows and equal ids each give a row and are one document; a null id is a component's id only if all its ids are
    null.  An empty table gives no rows.  Other columns are not read."""
    return _labelled(docs, words, bits, segment, distance, text, doc_id, similarity).drop("root")


def _labelled(docs: DataFrame, words: int, bits: int, segment: int, distance: int, text: str, doc_id: str, similarity: float | None) -> DataFrame:
    """The rows of near_duplicates() with their components' roots: unlike component_id, no two components share one."""
    exact = similarity is not None
    keys = ["fp", "shingles"] if exact else ["fp"]
    rows, _ = materialize(fingerprints(docs, words, bits, text, doc_id, exact), "fingerprints")
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *([F.min("text_hash").alias("text_hash")] if exact else []))
    groups, groups_at = materialize(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    nodes = _similar_components(docs, groups, segment, distance, words, similarity, text) if exact else components(links(groups, segment, distance))
    nodes = nodes.withColumnRenamed("node", "m")
    labelled, _ = materialize(groups.join(nodes, groups.node == nodes.m, "left").select(*keys, "least", "n", F.coalesce("root", "node").alias("root")), "labelled")
    drop(docs.sparkSession, groups_at)
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    found = spread_join(labelled.withColumnRenamed("n", "rows"), lowest, ["root"]).select(*keys, "component_id", "root", F.col("rows").alias("n"))
    out = spread_join(rows, found, keys)
    return out.select("doc_id", "text_hash", F.lower(F.hex(_reversed("fp"))).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")


def _reversed(name: str):
    """The octets of a binary column the other way round."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(name), F.lit("(..)"))), ""))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, bits: int = 320, segment: int = 20, distance: int = 68, similarity: float = 0.8) -> DataFrame:
    """One row of docs, with all its columns, of each component of near_duplicates(): one with the component's smallest id.

    At a similarity of 0.8 a bit differs with a probability of 0.15: 48 of 320 bits with a deviation of 6, so 999 of 1000
    such pairs are within the distance."""
    found, _ = materialize(_labelled(docs, words, bits, segment, distance, text, doc_id, similarity), "found")
    # of a component's rows with its smallest id, those of one text stay, and of those one row
    kept = found.where("kept").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = kept.groupBy("root").agg(F.min("text_hash").alias("first"))
    kept = kept.join(first, "root").select("doc_id", "text_hash", F.when(F.col("text_hash") == F.col("first"), F.col("n")).otherwise(0).alias("n"))
    ids = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    rows, _ = materialize(found.where("not kept").select("doc_id", "text_hash", F.lit(0).cast("long").alias("n")).distinct().unionByName(kept.where("n <> 1")).select(*ids, "n"), "rows")

    def of(marked: DataFrame):
        return docs[doc_id].eqNullSafe(marked["_id"]) & (F.xxhash64(docs[text]) == marked["_hash"])

    gone, many = rows.where("n = 0"), rows.where("n > 1")
    out = docs.join(gone, of(gone), "left_anti")
    if many.isEmpty():
        return out
    repeated = docs.join(many, of(many), "left_semi").dropDuplicates([doc_id, text])
    return out.join(many, of(many), "left_anti").unionByName(repeated)

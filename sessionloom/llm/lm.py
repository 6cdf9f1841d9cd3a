"""LM scoring by masked pseudo-likelihood.

A window network predicts each word from the two words before it and the two after it; a document's score is the sum of the
words' conditional log-probabilities.  Everything the network knows is counted over all words of all documents, in whole
numbers, so it and the scores are the same however the table is cut into partitions.

Words and units.  Of N words in all the most frequent ones are units of the network of their own; the others share units, a
third as many, by their hashes.  There are 1024 units, or 1024 * (N / 2**25)**(1/6) if that is more.  A shared unit's
probability is split among its words by their counts: those that occur sqrt(N) / LISTED times have their own, rarer ones what
these leave, in equal parts.  A word that occurs nowhere else in the corpus can't be known from other documents: it gets the
unit's part of such words and is spelled, octet by octet, each of the 256 and the end of the word with equal probability.  So
the probabilities of all words add up to 1, and a document that has a copy is told apart from one that has none.

The network.  Its input layer holds the units at the four places around a word, one weight for each place, unit and output;
its output is a softmax over classes of units, then one over the class's units.  A weight is the logarithm of how much more
often that output is found at that distance from that unit than elsewhere, shrunk by SHRINK counts.  The gains of the two
distances, the same in both softmaxes, are trained: a Newton step on the pseudo-likelihood of all words' classes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, release, text_bytes

#: The least number of units, and words in all up to which it stays; words before and after; the count, as a part of the root
#: of all words, from which a word's count is kept; the shrinkage of weights; words of a step; parts of the table of pairs.
UNITS, SMALL, SIDE, LISTED, SHRINK, STEP, PARTS = 1024, 1 << 25, 2, 64, 20.0, 2048, 64
#: The gains before training.
GAINS = (0.5, 0.3)
_SPELL = float(np.log(1 / 257))


def _document(doc_id: str, text: str):
    """A document's key: rows with one id and text have one."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(h, n, document, size): how often each word, by its hash, occurs in all documents, a document that has it, and its
    octets.  Counts are added up in tasks before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        owner: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts)).view(np.int64)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            who = np.fromiter(map(owner.__getitem__, counts), np.int64, len(counts))
            size = np.fromiter(map(len, counts), np.int64, len(counts))
            counts.clear()
            owner.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(who), pa.array(size)], ["h", "n", "document", "size"])

        for batch in batches:
            for body, key in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = (body or b"").split()
                counts.update(words)
                owner.update(dict.fromkeys(words, key))
                if len(counts) > 300_000:
                    yield flush()
        yield flush()
        release()

    rows = docs.select(F.col(text).alias("text"), _document(doc_id, text).alias("key")).mapInArrow(run, "h long, n long, document long, size long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.max("document").alias("document"), F.max("size").alias("size"))


class Vocabulary(NamedTuple):
    """Codes of words: 0 is the edge of a document, then the listed words by hash, then each shared unit's other words.

    units and shares: each code's unit, and the logarithm of the word's share of that unit's probability.  alone: the
    logarithm of the share, in each shared unit, of all words that occur once."""

    hashes: np.ndarray
    units: np.ndarray
    shares: np.ndarray
    alone: np.ndarray
    top: int
    side: int

    @property
    def size(self) -> int:
        return self.side * self.side

    @property
    def shared(self) -> int:
        return self.size - self.top - 1


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of word_counts().  The driver sees the listed words, about sqrt(N) of N, and a row per shared unit."""
    total = float(counts.agg(F.sum("n")).first()[0] or 0)
    side = int(np.ceil(np.sqrt(UNITS * max(1.0, total / SMALL) ** (1 / 6))))
    top = side * side * 3 // 4 - 1
    shared = side * side - top - 1
    least = max(2.0, total**0.5 / LISTED)
    rows = counts.where(F.col("n") >= least).select("h", "n").toArrow()
    if len(rows) < top:
        rows = counts.where("n > 1").orderBy(F.desc("n"), "h").limit(top).select("h", "n").toArrow()
    h, n = rows["h"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    whole, rest, kinds, once = (np.zeros(shared) for _ in range(4))
    np.add.at(whole, h[top:] % shared, n[top:])
    others = counts.where((F.col("n") < int(n[-1])) | ((F.col("n") == int(n[-1])) & (F.col("h") > int(h[-1])))) if len(h) else counts
    single = F.col("n") == 1
    if total:
        found = others.groupBy(F.pmod("h", F.lit(shared)).alias("k")).agg(F.sum(F.when(single, 0).otherwise(F.col("n"))).alias("n"), F.count(F.when(~single, 1)).alias("kinds"), F.count(F.when(single, 1)).alias("once"))
        for r in found.collect():
            rest[r["k"]], kinds[r["k"]], once[r["k"]] = r["n"], r["kinds"], r["once"]
    whole += rest + once
    units = np.concatenate([np.arange(1, min(top, len(h)) + 1), top + 1 + h[top:] % shared])
    shares = np.concatenate([np.zeros(min(top, len(h))), np.log(n[top:] / np.maximum(whole[h[top:] % shared], 1))])
    order = np.argsort(h)
    every = np.log(np.maximum(rest, 1) / np.maximum(kinds, 1) / np.maximum(whole, 1))
    alone = np.log(np.maximum(once, 1) / np.maximum(whole, 1))
    return Vocabulary(h[order], np.concatenate([[0], units[order], top + 1 + np.arange(shared)]).astype(np.int32), np.concatenate([[0.0], shares[order], every]), alone, top, side)


class _Codes(dict):
    """Codes of words, looked up as they come."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.hashes, self.shared = array("q", words.hashes.tobytes()), words.shared

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        signed = h - (1 << 64) if h >> 63 else h
        at, n = bisect_left(self.hashes, signed), len(self.hashes)
        found = self[word] = at + 1 if at < n and self.hashes[at] == signed else n + 1 + signed % self.shared
        return found


def coded(docs: DataFrame, known: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, codes) of each row: the document's key and its words' codes as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(known)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = []
                for body in text_bytes(part.column(2)):
                    words = (body or b"").split()
                    found.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], ["doc_id", "key", "codes"])
        release()

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("key", T.LongType()), T.StructField("codes", T.BinaryType())])
    return docs.select(F.col(doc_id).alias("doc_id"), _document(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a column of documents, with SIDE edges around each document, and the words of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(offsets) // 4
    out = np.zeros(int(sizes.sum()) + SIDE * (len(sizes) + 1), np.int32)
    if sizes.any():
        out[_places(sizes)] = np.frombuffer(column.buffers()[2], np.int32, int(sizes.sum()), int(offsets[0]))
    return out, sizes


def _places(sizes: np.ndarray) -> np.ndarray:
    """Places of the documents' words among the codes of _lines()."""
    return np.arange(int(sizes.sum())) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))


#: The places of the window, and the distance of each as an index of gains.
_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])
_DISTANCE = np.abs(_AROUND) - 1


def _blob(counts: np.ndarray) -> bytes:
    """Counts of a part of the table: places of those above zero, as steps, and the counts, by octet planes, compressed."""
    at = np.flatnonzero(counts)
    both = np.stack([np.diff(at, prepend=0), counts[at]]).astype("<u8")
    return np.int64(len(at)).tobytes() + pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2 * len(at), 8).T).tobytes(), "zstd", asbytes=True)


def _unblob(raw: bytes, size: int) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    both = np.ascontiguousarray(np.frombuffer(pa.decompress(raw[8:], 16 * n, "zstd", asbytes=True), np.uint8).reshape(8, 2 * n).T).view("<u8").reshape(2, n).astype(np.int64)
    out = np.zeros(size, np.int64)
    out[np.cumsum(both[0])] = both[1]
    return out


def pair_counts(rows: DataFrame, known: Vocabulary) -> np.ndarray:
    """[d, a, b], of coded rows: how often unit b stands d + 1 places after unit a; unit 0 is the edge of a document.

    Tasks add up their own pairs; PARTS parts of the table are added up apart."""
    units = known.size
    cells = SIDE * units * units
    width = -(-cells // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SIDE, units * units), np.int64)
        for batch in batches:
            if batch.num_rows:
                ids = known.units[_lines(batch.column(0))[0]].astype(np.int64)
                for d in range(1, SIDE + 1):
                    table[d - 1] += np.bincount(ids[:-d] * units + ids[d:], minlength=units * units)
        table.reshape(SIDE, units, units)[:, 0, 0] = 0  # two edges are no pair
        flat = table.ravel()
        parts = [k for k in range(PARTS) if flat[k * width : (k + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([_blob(flat[k * width : (k + 1) * width]) for k in parts], pa.binary())], ["part", "raw"])
        release()

    def add(blobs: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for raw in blobs["raw"]:
            total += _unblob(raw.as_py(), width)
        return pa.table({"part": blobs["part"][:1], "raw": pa.array([_blob(total)], pa.binary())})

    table = np.zeros(PARTS * width, np.int64)
    for r in rows.select("codes").mapInArrow(run, "part long, raw binary").groupBy("part").applyInArrow(add, "part long, raw binary").collect():  # PARTS rows
        table[r["part"] * width : (r["part"] + 1) * width] = _unblob(bytes(r["raw"]), width)
    return table[:cells].reshape(SIDE, units, units)


class Network:
    """Weights of both softmaxes for each place, without gains: [place, unit, class] and [place, unit, class, member]."""

    def __init__(self, pairs: np.ndarray, members_too: bool = True):
        units = pairs.shape[1]
        side = self.side = int(round(np.sqrt(units)))
        own = pairs[0].sum(0).astype(float)
        own[0] = 0  # an edge is no word
        classes = np.maximum(own.reshape(side, side).sum(1), 1e-3)
        self.log_class = np.log(classes / classes.sum()).astype(np.float32)
        members = np.maximum(own.reshape(side, side), 1e-3 / side)
        members = members / members.sum(1, keepdims=True)
        self.log_member = np.log(members).astype(np.float32)
        share = classes / classes.sum()
        self.to_class = np.empty((len(_AROUND), units, side), np.float32)
        self.to_member = np.empty((len(_AROUND), units, side, side) if members_too else (0,), np.float32)
        for k, place in enumerate(_AROUND):
            counts = pairs[_DISTANCE[k]] if place < 0 else pairs[_DISTANCE[k]].T
            counts = counts.astype(float)
            counts[:, 0] = 0
            cells = counts.reshape(units, side, side)
            sums = cells.sum(2)
            self.to_class[k] = np.log((sums / share + SHRINK) / (sums.sum(1, keepdims=True) + SHRINK))
            if members_too:
                self.to_member[k] = np.log((cells / members + SHRINK) / (sums[:, :, None] + SHRINK))

    def scaled(self, gains: np.ndarray) -> Network:
        """The same network with the gains, one for each distance, in its weights."""
        out = object.__new__(Network)
        out.side, out.log_class, out.log_member = self.side, self.log_class, self.log_member
        by_place = np.asarray(gains, np.float32)[_DISTANCE]
        out.to_class = self.to_class * by_place[:, None, None]
        out.to_member = self.to_member * by_place[:, None, None, None]
        return out

    def forward(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the target units in their windows [row, place].  With gains of 1 at most no sum is beyond what
        exp can take."""
        side, rows = self.side, np.arange(len(target))
        cls, member = target // side, target % side
        first, second = self.to_class[0].take(context[:, 0], axis=0), self.log_member.take(cls, axis=0)
        first += self.log_class
        for k in range(context.shape[1]):
            if k:
                first += self.to_class[k].take(context[:, k], axis=0)
            second += self.to_member[k].reshape(-1, side).take(context[:, k] * side + cls, axis=0)
        out = np.zeros(len(target))
        one = np.ones(side, np.float32)
        for z, own in ((first, cls), (second, member)):
            score = z[rows, own]
            np.exp(z, out=z)
            out += score - np.log(z @ one)
        return out

    def slopes(self, context: np.ndarray, target: np.ndarray, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient [distance] and the curvature [distance, distance] of the sum of the classes' log-probabilities."""
        rows, cls = np.arange(len(target)), target // self.side
        x = []
        for d in range(SIDE):
            before, after = np.flatnonzero(_DISTANCE == d)
            x.append(self.to_class[before].take(context[:, before], axis=0))
            x[d] += self.to_class[after].take(context[:, after], axis=0)
        p = np.exp(self.log_class + sum(np.float32(g) * v for g, v in zip(gains, x, strict=True)))
        p /= (p @ np.ones(self.side, np.float32))[:, None]
        slope, bend = np.zeros(SIDE), np.zeros((SIDE, SIDE))
        mean = [np.einsum("ij,ij->i", p, v).astype(float) for v in x]
        for i in range(SIDE):
            slope[i] = (x[i][rows, cls] - mean[i]).sum()
            weighted = p * x[i]
            for j in range(i + 1):
                bend[i, j] = bend[j, i] = (np.einsum("ij,ij->i", weighted, x[j]) - mean[i] * mean[j]).sum()
        return slope, bend


class Model(NamedTuple):
    """unseen: (document, n_unseen, change) of the documents with words that occur nowhere else, and what those words change
    in the documents' sums; None if only other documents are scored."""

    words: Vocabulary
    pairs: bytes
    gains: np.ndarray
    unseen: DataFrame | None

    def network(self) -> Network:
        units = self.words.size
        return Network(_unblob(self.pairs, SIDE * units * units).reshape(SIDE, units, units)).scaled(self.gains)


def _gains(rows: DataFrame, known: Vocabulary, pairs: bytes) -> np.ndarray:
    """The gains after a Newton step over all words, to two decimals: sums in another order give the same."""
    units = known.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(_unblob(pairs, SIDE * units * units).reshape(SIDE, units, units), False)
        slope, bend = np.zeros(SIDE), np.zeros((SIDE, SIDE))
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = _lines(batch.column(0))
            ids, places = known.units[found], _places(sizes)
            for at in range(0, len(places), STEP):
                own = places[at : at + STEP]
                s, b = net.slopes(ids[own[:, None] + _AROUND], ids[own], GAINS)
                slope, bend = slope + s, bend + b
        yield pa.RecordBatch.from_arrays([pa.array([[*slope.ravel(), *bend.ravel()]], pa.list_(pa.float64()))], ["sums"])
        release()

    size = SIDE + SIDE * SIDE
    sums = rows.select("codes").mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)]).first()
    flat = np.array([v or 0.0 for v in sums])
    slope, bend = flat[:SIDE], flat[SIDE:].reshape(SIDE, SIDE)
    step = np.linalg.solve(bend + 1e-3 * np.eye(SIDE) * (1 + np.trace(bend)), slope)
    return np.round(np.clip(np.array(GAINS) + step, 0, 1), 2)


def _train(docs: DataFrame, text: str, doc_id: str) -> tuple[Model, DataFrame]:
    """The model, and the coded rows that it was trained on, written."""
    counts, counts_at = materialize(word_counts(docs, text, doc_id), "counts")
    known = vocabulary(counts)
    change = F.get(F.lit([float(x) for x in known.alone - known.shares[-known.shared :]]), F.pmod("h", F.lit(known.shared)).cast("int")) + (F.col("size") + 1) * F.lit(_SPELL)
    unseen = counts.where("n = 1").groupBy("document").agg(F.count("*").alias("n_unseen"), F.sum(change.cast("decimal(20,6)")).cast("double").alias("change"))
    unseen, _ = materialize(unseen, "unseen")
    drop(docs.sparkSession, counts_at)
    rows, _ = materialize(coded(docs, known, text, doc_id), "codes")
    pairs = _blob(pair_counts(rows, known).ravel())
    return Model(known, pairs, _gains(rows, known, pairs), unseen), rows


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The vocabulary, the network and the words that occur once, from all rows of docs.

    Null and empty texts have no words.  Repeated rows count as often as they are there, so their words occur elsewhere.  An
    empty table gives a model in which all units are alike.  The driver sees the listed words and the table of pairs, both of
    which grow with the corpus more slowly than its root."""
    return _train(docs, text, doc_id)[0]


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_unseen, log_likelihood (the sum over all words) and mean_log_likelihood (null without words) of each
    row.  n_unseen: words that occur nowhere else in the documents that the model was trained on.

    Null and empty texts have no words and a sum of 0.  Repeated rows are scored one by one, alike.  An empty table gives no
    rows.  Other columns are not read."""
    return _scored(coded(docs, model.words, text, doc_id), model)


def score_corpus(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """score() of the rows that the model is trained on; their words are looked up once."""
    model, rows = _train(docs, text, doc_id)
    return _scored(rows, model)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    known, shell = model.words, model._replace(unseen=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shell.network()
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = _lines(batch.column(2))
            units, places = known.units[found], _places(sizes)
            flat = np.zeros(len(places) + 1)
            for at in range(0, len(places), STEP):
                own = places[at : at + STEP]
                flat[at : at + len(own)] = net.forward(units[own[:, None] + _AROUND], units[own]) + known.shares[found[own]]
            some, total = np.flatnonzero(sizes), np.zeros(len(sizes))
            total[some] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[some])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(total)], ["doc_id", "key", "n_words", "total"])
        release()

    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("total", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    if model.unseen is not None:
        out = out.join(model.unseen, F.col("key") == F.col("document"), "left")
    else:
        out = out.withColumns({"n_unseen": F.lit(0), "change": F.lit(0.0)})
    total = F.round(F.col("total") + F.coalesce("change", F.lit(0.0)), 4)
    return out.select("doc_id", "n_words", F.coalesce("n_unseen", F.lit(0)).cast("long").alias("n_unseen"), total.alias("log_likelihood"), (total / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("mean_log_likelihood"))

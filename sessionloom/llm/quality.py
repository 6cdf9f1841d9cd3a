"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown here in numpy on histograms, by the logistic loss, and flattened into node arrays; scoring walks all
documents of a batch through a tree one level at a time.  Features of MONOTONE can only lower (-1) or raise (+1) a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Of which the trees see these; -1: more of it never raises a score.
MONOTONE = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "mark_share": -1, "distinct_share": 0, "run_share": -1}
FEATURES = list(MONOTONE)
#: Labelled rows that the fit uses at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b"!?|*#$%&<>{}[]=+_~^@\\/"


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    window = pair[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, at, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def _uppercase(text: str) -> int:
    """Characters that lower() changes; a text whose lower case has another length is counted one by one."""
    a, b = text.encode("utf-32-le"), text.lower().encode("utf-32-le")
    return int(np.count_nonzero(np.frombuffer(a, "<u4") != np.frombuffer(b, "<u4"))) if len(a) == len(b) else sum(map(str.isupper, text))


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base numbers and the features of a whole text; a null text has no words."""
    text = text or b""
    words = text.split()  # the white space of bytes is 0x20 and 0x09 to 0x0D
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80))
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(ids)
    upper = len(joined) - len(joined.translate(None, _UPPER)) if joined.isascii() else _uppercase(joined.decode("utf-8", "replace"))
    runs = int((ids[1:] == ids[:-1]).sum()) if n > 1 else 0
    over = max(1, chars)
    features = [np.log1p(n), chars / max(1, n), symbols / over, dup / max(1, lines), repeats / max(1, n), upper / over, (len(joined) - len(joined.translate(None, _DIGIT))) / over, (len(joined) - len(joined.translate(None, _MARKS))) / over, len(number) / max(1, n), runs / max(1, n)]
    return [n, chars, symbols, dup, repeats], features


@dataclass
class Trees:
    """All trees' nodes in one set of arrays.  A leaf is its own child; root: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of each row."""
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees.  A split of a constrained feature must order its sides; below it, each side's leaves keep to its side
    of the midpoint, so the whole sum is monotone in the feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if len(x) else np.zeros(x.shape, int)
    mean = min(max((y.sum() + 1) / (len(y) + 2), 1e-6), 1 - 1e-6)
    bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(x), bias)
    nodes: list[list[float]] = []
    roots = []
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf = float(np.clip(-gs / (hs + ridge), low, high))
            nodes.append([0, np.inf, at, at, leaf * rate])
            best = None
            if level < depth:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - (gr * vr + (hr + ridge) * vr**2 / 2) + (gs * leaf + (hs + ridge) * leaf**2 / 2)
                    gain[(hl < least) | (hr < least) | (monotone[j] * (vr - vl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, vl[k], vr[k])
            if best is None:
                total[rows] += leaf * rate
                return at
            _, j, k, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone[j]]
            goes = binned[rows, j] <= k
            nodes[at][0], nodes[at][1] = j, float(edges[j][k])
            nodes[at][2] = grow(rows[goes], level + 1, *bounds[0])
            nodes[at][3] = grow(rows[~goes], level + 1, *bounds[1])
            return at

        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
    f, t, le, r, v = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0),) * 5
    return Trees(f.astype(int), t.astype(float), le.astype(int), r.astype(int), v.astype(float), np.array(roots, int), depth, bias)


def _with_stats(docs: DataFrame, text: str, keep: list[str], model: Trees | None, threshold: float, only_kept: bool) -> DataFrame:
    """keep columns; with a model, base_failed, score and kept too; without one, the features."""
    extra = [("features", T.ArrayType(T.DoubleType()))] if model is None else [*[(c, T.LongType()) for c in BASE], ("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())]
    if only_kept:
        extra = []
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t) for n, t in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [statistics(t) for t in text_bytes(batch.column("_text"))]
            x = np.array([f for _, f in both], float)
            columns = [batch.column(c) for c in keep]
            if model is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(x), pa.list_(pa.float64()))], [*keep, "features"])
                continue
            base = np.array([b for b, _ in both], np.int64)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = model.score(x)
            kept = ~failed & (score >= threshold)
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, keep).filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(base[:, i]) for i in range(5)], pa.array(failed), pa.array(score), pa.array(kept)], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 5) -> Trees:
    """Trees for P(label = 1), fitted on at most fit_rows labelled documents.

    The bound is on the labels before they meet the documents, so the side that is broadcast is bounded too.  Labels that
    are null, and ids labelled both ways, are left out.  Without labels of both kinds the trees are empty: all score alike."""
    good = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("_low"), F.max(label).alias("_y")).where("_low = _y")
    good = good.select(F.col(doc_id).alias("_id"), "_y").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(fit_rows)
    pairs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(good), "_id")
    rows = _with_stats(pairs, "text", ["_id", "_y"], None, 0, False)
    rows = rows.groupBy("_id").agg(F.min(F.struct("_y", "features")).alias("r")).select("_id", "r.*").orderBy("_id").toPandas()  # one row per label
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy(float), [MONOTONE[c] for c in FEATURES])


def judge(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base numbers, base_failed, score and kept of each row.

    Null and empty texts have no words, so they fail the base rules.  Repeated rows are judged one by one, alike."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _with_stats(named, "text", ["doc_id"], model, threshold, False)


def kept_documents(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns: one pass, no shuffle."""
    return _with_stats(docs, text, docs.columns, model, threshold, True)

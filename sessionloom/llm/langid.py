"""Language ID by hierarchical discrimination.

A linear model over hashed character n-grams predicts the language family; within a family, linear support vector machines,
one for each pair of its languages, vote.  All are trained here in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes

#: Languages (ISO 639-1) by family.  A language that isn't here is a family of its own.
FAMILIES = {
    "romance": "ca es fr gl it la oc pt ro",
    "germanic": "af da de en is lb nl no sv yi",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
#: Labelled documents per language that the fit uses, about; and hashed n-gram features.
FIT_PER_LANG, FEATURES = 500, 1 << 12


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of one to four octets of the whole text in lower case, square roots, of length 1."""
    data = np.frombuffer(b" " + re.sub(r"[\W\d_]+", " ", text.lower()).encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES)
    code = data
    for n in (1, 2, 3, 4):
        if n > 1:
            if len(data) < n:
                break
            code = code[:-1] * np.uint32(257) + data[n - 1 :]
        h = (code + np.uint32(n)) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(20), minlength=FEATURES)
    out = np.sqrt(out)
    return out / np.sqrt(out @ out)


def _softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 200, rate: float = 8.0, decay: float = 1e-5) -> np.ndarray:
    """Weights of a multinomial logistic regression, by full gradient steps with momentum."""
    w, speed = np.zeros((x.shape[1], classes)), np.zeros((x.shape[1], classes))
    share = np.bincount(y, minlength=classes) / len(y)
    weight = (1 / classes / np.maximum(share, 1e-9))[y] / len(y)
    for _ in range(steps if classes > 1 else 0):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        speed = 0.9 * speed - rate * (x.T @ (p * weight[:, None]) + decay * w)
        w += speed
    return w


def _svm_fit(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 3) -> np.ndarray:
    """A linear support vector machine for y = -1 or 1, by dual coordinate descent on the squared hinge (Hsieh et al. 2008)."""
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    counts = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    diagonal = np.array([counts[s] / len(y) / cost for s in y])
    norms = (x * x).sum(1) + diagonal
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - g / norms[i])
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


class Model:
    """Families, their languages, and the weights of both levels."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY.get(lang, lang) for lang in self.langs})
        self.members = [[lang for lang in self.langs if FAMILY.get(lang, lang) == f] for f in self.families]
        if not langs:
            return
        at = {f: i for i, f in enumerate(self.families)}
        y = np.array(langs)
        self.family = _softmax_fit(x, np.array([at[FAMILY.get(lang, lang)] for lang in langs]), len(self.families))
        self.pairs = {}
        for members in self.members:
            for a, b in combinations(members, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = _svm_fit(x[rows], np.where(y[rows] == a, 1, -1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        z = x @ self.family
        p = np.exp(z - z.max())
        p /= p.sum()
        f = int(np.argmax(p))
        members = self.members[f]
        if len(members) == 1:
            return members[0], float(p[f])
        votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            margin = float(x @ self.pairs[a, b])
            votes[a if margin >= 0 else b] += 1
            sums[a] += margin
            sums[b] -= margin
        best = max(members, key=lambda m: (votes[m], sums[m]))
        return best, float(p[f] / (1 + np.exp(-4 * sums[best] / (len(members) - 1))))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_lang: int = FIT_PER_LANG, seed: int = 11) -> Model:
    """A model from about per_lang documents of each language, those with the smallest hashes of their ids.

    Only rows with a text, a language and a remainder other than 0 are used; none of them gives a model without languages.  Each language's share of rows to take follows from its
    count, so the sample is bounded whatever the size of the table, and no task gathers a language."""
    rows = docs.where(F.col(lang).isNotNull() & (remainder(F.col(doc_id)) != 0) & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return Model(np.zeros((0, FEATURES)), [])
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n))])
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(hashed < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["lang", "x"])

    found = sample.mapInArrow(run, "lang string, x binary").limit(4 * per_lang * len(counts)).collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.array([np.frombuffer(r[1], np.float32) for r in found], float).reshape(-1, FEATURES)
    return Model(x, [r[0] for r in found])


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its whole text alone.

    Texts that are null, or have no letter (a character of which str.isalpha() holds), are `und` with score 0; so is everything if no language was learned.  held_out is
    null for a null id.  Repeated rows are predicted one by one, alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in text_bytes(batch.column(2)):
                wide = (body or b"").decode("utf-8", "replace")
                out.append(model.predict(features(wide)) if model.langs and any(map(str.isalpha, wide)) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("doc_id"), (remainder(F.col(doc_id)) == 0).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)

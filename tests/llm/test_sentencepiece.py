"""The parallel scan against the library's own encoding."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from sessionloom.llm import sentencepiece_scan as scan

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def coder():
    return scan.Encoder(public_tokenizers.path("piece_bpe_32k.model"))


def test_same_as_the_library(coder):
    rng = random.Random(1)
    signs = "abcdetinrsos  \n\té中文ﬁ▁\U0001f600xyzTHE.-=0123"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for text, (raw, _) in zip(texts, coder.encode_all(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == coder.model.encode(text), text
        assert coder.decode(ids) == coder.model.decode(ids), text


@pytest.mark.parametrize("size", [16, 17, 64, 8192])
def test_chunks_of_any_size(coder, size):
    rng = random.Random(size)
    signs = ["the", "ing", "tion", "a", "e", "qu", "中", "1", "===", "\U0001f600", "\n"]
    for n in range(25):
        word = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 6 if n % 2 else 60)))
        text = (" " if n % 3 else "  ").join(word() for _ in range(rng.randint(1, 60)))
        text = "a" * rng.randint(600, 1500) if n == 0 else text + " " * 100 + text if n == 1 else " " * 700 if n == 2 else text
        assert coder.encode(text, size) == coder.model.encode(text), (n, text)
        assert "".join(c[1] for c in coder.chunks(text, size)) == "▁" + text.replace(" ", "▁")


def test_products_are_associative():
    rng = random.Random(3)
    every = [("x", i) for i in range(4)]
    for _ in range(50):
        a, b, c = ({s: frozenset(t for t in every if rng.random() < 0.4) for s in every} for _ in range(3))
        assert scan.combine(scan.combine(a, b), c) == scan.combine(a, scan.combine(b, c)) == scan.product([a, b, c])


def test_checksums_join():
    rng = random.Random(4)
    for _ in range(20):
        a, b = rng.randbytes(rng.randint(0, 50)), rng.randbytes(rng.randint(0, 50))
        assert scan.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_frames(spark, coder):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    syllables = ["th", "er", "on", "an", "tion", "é", "ing", ".\n"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(n))
    rows = [(1, "hello  world"), (2, None), (3, ""), (3, "é" * 700), (None, "x"), (4, "▁a"), (5, prose(300)), (6, "ab" * 34_000), (7, prose(30_000)), (7, prose(20_000)), (None, " " * 9_000 + "\U0001f600")]
    rows += [(8, rows[8][1])] * 2
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, ids string, key int").repartition(3)
    got = sorted(scan.encode(docs, path).collect(), key=str)
    want = sorted(((i, coder.model.encode(t or ""), -(-len("▁" + t) // scan.CHUNK) if t else 0) for i, t in rows), key=str)
    assert sorted(((r.doc_id, list(r.ids), r.n_chunks) for r in got), key=str) == want
    assert sum(r.n_chunks > 8 for r in got) == 5
    assert all(r.decoded and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert scan.encode(docs.limit(0), path).count() == 0

"""Operators against brute-force versions, on rows with nulls, empty texts, repeats, ties and other columns."""

from __future__ import annotations

import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sessionloom.llm import ego_join, langid, lm, mixing, quality, rindex, sharding, simhash, token_coder
from sessionloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, position string"


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 120)))
        if i % 4 == 0:
            text = text[: len(text) // 2] + " " + shared + "\n" + text[len(text) // 2 :]
        rows.append((i, text, "en" if i % 2 else "fr", f"src{i % 3}", len(text)))
    rows += [(100, None, "en", "src0", 0), (101, "", None, None, 0), (102, " \n\t", "fr", None, 3), (103, rows[5][1], "en", "src1", 1), (104, rows[5][1], "en", "src1", 1), (104, rows[5][1], "en", "src1", 1), (105, "only three words", "en", "src1", 1), (None, rows[8][1], "fr", "src2", 1), (106, "x" * 4000, "en", "src2", 4000)]
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).repartition(3).cache()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def size(text):
    return len((text or "").encode().split())


def test_mixing(docs):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in rows)))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, [3, 1, 2, 3], strict=True))
    left, free, target = 1.5 * sum(sizes.values()), {s for s in order if sizes[s]}, dict.fromkeys(order, 0.0)
    while free:
        over = [s for s in free if left * weights[s] / sum(weights[x] for x in free) >= 2 * sizes[s]]
        if not over:
            for s in free:
                target[s] = left * weights[s] / sum(weights[x] for x in free)
            break
        left -= sum(2 * sizes[s] for s in over)
        for s in over:
            target[s] = 2 * sizes[s]
            free.discard(s)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert sum(r.taken for r in own) == round(target[s])
    assert all(r.taken <= 2 * r.size and (r.position is None) == (not r.passes) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + len(r.passes)
    found = {}
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in times.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedules_are_inverted():
    knots = ((0.0, 1.0), (0.25, 0.0), (0.5, 0.0), (1.0, 4.0))
    x = np.linspace(0, 1, 101)
    t = mixing.invert(knots, x)
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, *np.array(knots).T)
    done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
    assert np.abs(np.interp(t, grid, done / done[-1]) - x).max() < 1e-6 and (np.diff(t) >= 0).all()


def brute_statistics(text):
    t = (text or "").encode()
    words = t.split()
    dup, seen = 0, set()
    for line in t.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(len(w.decode()) for w in words), sum(t.decode().count(c) for c in "#*$%&|<>"), dup, len(hit)]


def test_quality_statistics():
    rng = random.Random(2)
    for n in range(200):
        text = "".join(rng.choice(["a ", "b ", "é ", "c\n", "\n", "#x ", "|", "  "]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text.encode())[0] == brute_statistics(text), n
    assert quality.statistics(None)[0] == [0] * 5


def test_quality_trees(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3) | (rng.random(3000) < 0.05)).astype(float)
    model = quality.fit(x, y, [-1, 0, 1])
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 50)
    for other in rng.random((20, 3)):
        lines = np.repeat(other[None], 50, 0)
        for j, sign in ((0, -1), (2, 1)):
            moved = lines.copy()
            moved[:, j] = grid
            assert (sign * np.diff(model.score(moved)) >= -1e-12).all()
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)] + [(5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels)
    got = {str(r.doc_id): r for r in quality.judge(docs, trees).collect()}
    for r in docs.collect():
        g, b = got[str(r.doc_id)], brute_statistics(r.text)
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == b
        assert g.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (g.base_failed and g.kept)
    kept = quality.kept_documents(docs, trees)
    assert kept.columns == docs.columns and {str(r.doc_id) for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert len(quality.train(docs, labels.limit(0)).root) == 0 and quality.judge(docs.limit(0), trees).count() == 0


def test_sharding(docs, tmp_path):
    got = sharding.shard(docs, f"file://{tmp_path}/a", shards=5, rows_per_bucket=8).collect()
    rows = docs.collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in rows)))
    by_shard = {s: sorted(r.slot for r in got if r.shard == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in by_shard.values()) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    crc = {str(r.doc_id): (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows}
    assert all((r.size, r.text_crc32) == crc[str(r.doc_id)] and r.law == "rows" for r in got)
    again = sharding.shard(docs.repartition(7), f"file://{tmp_path}/b", shards=5, rows_per_bucket=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = sharding.write_shards(docs, f"file://{tmp_path}/c", shards=3, rows_per_bucket=8)
    assert out.columns == [*docs.columns, "slot", "shard"] or out.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (r.text for r in rows))) and out.select("shard").distinct().count() == 3
    assert sharding.shard(docs.limit(0), f"file://{tmp_path}/d").count() == 0
    few = sharding.shard(docs.where("doc_id < 3"), f"file://{tmp_path}/e").collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("h", "slot"), f"file://{tmp_path}/f")


def test_sharding_is_fisher_yates_by_bucket(docs, tmp_path):
    """The permutation again: rows by bucket, in order of their keys, shuffled with the bucket's seed."""
    from pyspark.sql import functions as F

    own = docs.where("doc_id < 100").select("doc_id", "text")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(own, f"file://{tmp_path}/g", shards=4, rows_per_bucket=16).collect()}
    key = F.struct(F.col("doc_id").alias("a"), F.crc32(F.col("text").cast("binary")).alias("b"), F.octet_length("text").alias("c"))
    rows = own.select("doc_id", F.pmod(F.xxhash64(F.lit(23), key), F.lit(4)).alias("bucket")).collect()
    places = []
    for b in range(4):
        ids = sorted(r.doc_id for r in rows if r.bucket == b)
        places += [ids[k] for k in sharding.fisher_yates(len(ids), 23, b)]
    assert got == {i: (p // 15, p % 15) for p, i in enumerate(places)}


def test_sharding_splits_a_hot_key(spark, tmp_path):
    same = spark.createDataFrame([(7, "t")] * 900 + [(i, "u") for i in range(100)], "doc_id long, text string")
    got = sharding.shard(same, f"file://{tmp_path}/h", shards=4, rows_per_bucket=50).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(250)]


def brute_links(rows):
    """(id, links, smallest id of the component) of rows (id, vector)."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    count, label = [0] * n, list(range(n))
    pairs = []
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.95:
                    pairs.append((i, j))
                    count[i] += 1
                    count[j] += 1
    for _ in range(n):
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    least = {}
    for i in range(n):
        least[label[i]] = min(least.get(label[i], 1 << 60), rows[i][0])
    return sorted((rows[i][0], count[i], least[label[i]]) for i in range(n))


def test_ego_join(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("BASE", 4), ("FAN", 2)):
        monkeypatch.setattr(ego_join, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 5))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + rng.normal(size=5) * 0.2)]) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(10)] + [(-1, rows[7][1]), (300, None), (301, []), (302, [0.0] * 5), (303, [1.0, None, 0.0, 0.0, 0.0]), (304, [float("nan")] * 5), (305, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e200, 2e200]), (309, [1e-310, 2e-310]), (8, rows[8][1])]
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = ego_join.near_duplicates(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert ego_join.near_duplicates(frame.limit(0)).count() == 0


def test_simhash_links(spark, docs):
    import xxhash

    rows = docs.where("doc_id is not null").collect()

    def slow(text):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [slow(r.text) for r in rows]
    label = list(range(len(rows)))
    for _ in range(5):
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, r in enumerate(rows):
        least[label[i]] = min(least.get(label[i], 1 << 60), r.doc_id)
    want = sorted((r.doc_id, f"{fps[i]:016x}", least[label[i]]) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs.where("doc_id is not null"), 3, 64, 32, 3).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.where("doc_id in (103, 104) or doc_id is null").count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_finds_all_near_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            for _ in range(6):
                x = b
                for bit in rng.sample(range(64), k):
                    x ^= 1 << bit
                values.add(x)
    values |= {base[0] & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(300)}
    values = sorted(values)
    rows = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "little"))) for i, v in enumerate(values)], "node long, fp binary")
    a = np.array(values, np.uint64)
    u, v = np.nonzero(np.bitwise_count(a[:, None] ^ a[None]) <= 3)
    from sessionloom.llm.common import find_roots

    nodes, roots = find_roots(u[u < v], v[u < v])
    got = {r.node: r.root for r in components(simhash.links(rows, 32, 3)).collect()}
    assert got == dict(zip(nodes.tolist(), roots.tolist(), strict=True))


def test_simhash_similarity():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    hits = 0
    for _ in range(40):
        text = [rng.choice(words) for _ in range(300)]
        near = list(text)
        for at in rng.sample(range(300), 3):
            near[at] = rng.choice(words)
        a, b = (np.frombuffer(simhash.fingerprint(" ".join(t).encode(), 5, 320), np.uint64) for t in (text, near))
        hits += int(np.bitwise_count(a ^ b).sum()) <= 55
    assert hits >= 39


def brute_similar(rows):
    """The smallest id of each id's component of texts whose sets of five-word shingles have a similarity of 0.8."""

    def grams(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}
    pairs = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in label:
        before = dict(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


def test_pipeline_near_duplicates_are_those_of_brute_force(spark):
    import corpus_pipeline

    rng, rows = random.Random(6), []
    words = [f"w{i}" for i in range(5000)]
    for edits in (1, 3, 4, 5, 6, 6, 7, 7, 8, 8, 9, 10, 11, 12):  # of 300 words: similarities from 0.97 to 0.66, most of them around 0.8
        base = [rng.choice(words) for _ in range(300)]
        rows.append(base)
        for _ in range(6):
            near = list(base)
            for at in rng.sample(range(300), edits):
                near[at] = rng.choice(words)
            rows.append(near)
    rows += [["x"] * 300, ["x"] * 200 + rows[0][:80], ["x"] * 250 + rows[0][:80], rows[3]]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    label = brute_similar(rows)
    assert 10 < len({x for x in label.values()}) < 80
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label.values()))


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (1, a), (1, a + " more"), (2, a), (3, b), (None, c), (None, c), (None, c + " more"), (3, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text[0]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (3, "b"), (3, "q"), (None, "c")], key=str)


def test_pipeline_against_its_stages_by_brute_force(spark, tmp_path, monkeypatch):
    """The whole pipeline over a small table: what each stage must leave is found again in plain Python."""
    import corpus_pipeline
    from sessionloom.llm import common

    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(80):
        body = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        if i % 5 == 0:
            body[10:10] = passage.split()
        rows.append((i, " ".join(body), "en", f"s{i % 3}", 0))
    rows += [(90, rows[4][1], "en", "s1", 0), (91, None, "en", "s0", 0), (92, "", None, None, 0), (93, "again " * 80, "en", "s0", 0), (94, rows[7][1] + " more", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = common.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    # without labels the trees say nothing, so the base rules decide
    good = [(r[0], r[1], r[3]) for r in rows if (b := brute_statistics(r[1]))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    label = brute_similar([(i, t) for i, t, _ in good])
    kept = [(i, t, s) for i, t, s in good if label[i] == i]
    assert 0 < len(kept) < len(good) < len(rows)
    first, cut = {}, []
    for i, t, _ in sorted(kept):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t, s in kept:
        gone = {p + k for p in range(len(t) - 49) if first[t[p : p + 50]] < i for k in range(50)}
        cut.append((i, "".join(ch for p, ch in enumerate(t) if p not in gone), s))
    assert any(len(a[1]) < len(b[1]) for a, b in zip(cut, kept, strict=True))
    sizes = {}
    for _, t, s in cut:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = dict(zip(sorted(sizes), mixing.share_out([sizes[s] for s in sorted(sizes)], [3, 1, 2], 1.5 * sum(sizes.values()), 2.0), strict=True))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {i: model.encode(t) for i, t, _ in cut}
    times = {}
    for r in got:
        assert list(r.ids) == ids[r.doc_id] and r.decoded
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for s in sizes:  # every document whole as often as the target goes round, and one of them cut at its end
        own = [times.get(i, 0) for i, t, x in cut if x == s and t.split()]
        words_taken = sum(times.get(i, 0) * len(t.split()) for i, t, x in cut if x == s)
        assert max(own) <= 2 and max(own) - min(own) <= 1 and round(targets[s]) <= words_taken <= round(targets[s]) + max(len(t.split()) for _, t, x in cut if x == s)
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before}
    assert not left & {"quality_rules", "near_duplicates", "repeats", "fingerprints", "strings"}


def brute_repeats(rows):
    first, out = {}, {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, 1 << 60), i)
    for i, t in rows:
        cut = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                cut[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, cut, strict=True) if not x)
        out[i] = (len(t), sum(cut), sum(1 for k, x in enumerate(cut) if x and (k == 0 or not cut[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, monkeypatch, hot):
    monkeypatch.setattr(rindex, "HOT", hot)
    monkeypatch.setattr(rindex, "BUCKET_BYTES", 4000)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.where("doc_id is not null").collect()]
    want = brute_repeats(rows)
    got = rindex.repeats(docs.where("doc_id is not null")).collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("name", ["quality_base_numbers", "shard_sizes", "op8_suffix_array", "op4_ego_join"])
def test_queries_agree_with_sql(spark, name):
    duckdb, path = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.exists(path):
        pytest.skip("no tables")
    from sessionloom.llm import queries

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{path}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, path)
    assert sorted(got.columns) == columns
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.select(*columns).fetchall()))


def test_very_long_texts(spark):
    """One text of megabytes beside short ones: the same numbers as for its parts alone."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, "a few words"), (3, long), (4, None)], "doc_id long, text string")
    stats = {r.doc_id: r for r in quality.judge(docs, quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()}
    assert stats[1].n_words == 120_000 and stats[1].n_repeat_words == 0 and stats[1].n_words == stats[3].n_words
    same = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 3, 64, 32, 3).collect()}
    assert same[1] == same[3] == 1 and same[2] == 2
    scored = {r.doc_id: r for r in lm.score_corpus(docs).collect()}
    assert scored[1].n_words == 120_000 and scored[1].log_likelihood == scored[3].log_likelihood and scored[1].n_unseen == 0
    gone = {r.doc_id: r.n_removed for r in rindex.repeats(docs).collect()}
    assert gone == {1: 0, 2: 0, 3: len(long), 4: 0}


def test_repeats_are_told_by_the_index(docs, monkeypatch):
    def blind(rows):
        return pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "text_hash", "span", "digest")})

    assert sum(r.n_removed for r in rindex.repeats(docs).collect()) > 0
    monkeypatch.setattr(rindex, "_match", blind)
    assert sum(r.n_removed for r in rindex.repeats(docs).collect()) == 0


def test_repeats_edges(spark, docs):
    periodic = spark.createDataFrame([(1, "ab" * 400), (2, "ba" * 400), (3, "x" + "ab" * 30), (2, "q" * 60), (4, "q" * 60)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in rindex.repeats(periodic).collect())
    assert got == [(1, 0), (2, 0), (2, 800), (3, 60), (4, 60)]
    lone = rindex.repeats(docs.where("doc_id is null")).collect()
    assert len(lone) == 1 and lone[0].n_removed == 0
    out = rindex.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text is null").count() == 1
    assert rindex.repeats(docs.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(6)
    vocabulary = {"en": "the of and to in is that for it was", "de": "der die und das ist nicht ein mit zu den", "fr": "le la les des une est dans que pour qui", "es": "el los las una es en que por con del", "xx": "ka ki ku kaka kiki"}
    rows = [(i, " ".join(rng.choice(vocabulary[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(vocabulary) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, " 12 .", "de"), (902, "", None), (None, "the of and", "en"), (903, "der die und das ist", None), (904, "\u00bd \u2461 \u2167", "en"), (905, "der die und das ist nicht " * 5000, None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, _, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
        assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904, 905)] == ["und", "und", "und", "de", "und", "de"]
    for i in (0, 1, 2, 3, 903):  # the prediction again: features, families and votes one by one
        text = next(t for j, t, _ in [*rows, (903, "der die und das ist", None)] if j == i)
        data, counts = (" " + text.lower() + " ").encode(), {}
        for n in (1, 2, 3, 4):
            for at in range(len(data) - n + 1):
                code = 0
                for c in data[at : at + n]:
                    code = (code * 257 + c) % (1 << 32)
                k = ((code + n) * 2654435761 % (1 << 32)) >> 20
                counts[k] = counts.get(k, 0) + 1
        norm = sum(counts.values()) ** 0.5
        x = {k: v**0.5 / norm for k, v in counts.items()}
        z = [sum(v * model.family[k, f] for k, v in x.items()) for f in range(len(model.families))]
        members = model.members[z.index(max(z))]
        votes = {m: [0, 0.0] for m in members}
        for (a, b), w in model.pairs.items():
            if a in votes:
                margin = sum(v * w[k] for k, v in x.items())
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
        assert got[i].lang_pred == max(members, key=lambda m: votes[m])
    clash = docs.selectExpr("doc_id", "text", "lang", "1 as held_out", "'x' as x", "lang as lang_pred")
    assert sorted(map(str, langid.identify(clash, langid.train(clash)).collect())) == sorted(map(str, got.values()))
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(docs.limit(0), model).count() == 0


def test_language_id_on_held_out_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no documents")
    docs = spark.read.parquet(path)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify(docs, langid.train(docs)).collect() if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def lm_corpus(rng, n, words=400):
    """Two languages of words with Zipf's counts, in documents of one language, and some rare words."""
    rows = []
    for k in range(n):
        own = [f"{'ab'[k % 2]}{min(int(rng.paretovariate(0.9)), words)}" for _ in range(rng.randint(20, 90))]
        own[5] = f"rare{k}"
        rows.append(" ".join(own))
    return rows


def brute_scores(texts):
    """Each text's score, word by word, from counts of all texts."""
    import math

    import xxhash

    h = lambda w: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(w))
    docs = [(t or "").encode().split() for t in texts]
    counts = {}
    for w in (w for d in docs for w in d):
        counts[w] = counts.get(w, 0) + 1
    side, top = 32, 767
    listed = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], h(w)))
    root = sum(counts.values()) ** 0.5
    many = [w for w in listed if counts[w] >= max(2.0, root / lm.LISTED)]
    listed = many if len(many) >= top else listed[:top]
    unit = {w: i + 1 for i, w in enumerate(listed[:top])}
    unit.update({w: top + 1 + h(w) % (1024 - top - 1) for w in counts if w not in unit})
    total, rest, kinds, once = ({u: 0 for u in range(1024)} for _ in range(4))
    for w, n in counts.items():
        if unit[w] > top:
            total[unit[w]] += n
            if n == 1:
                once[unit[w]] += 1
            elif w not in listed:
                rest[unit[w]] += n
                kinds[unit[w]] += 1
    lines = [[0, 0, *[unit[w] for w in d], 0, 0] for d in docs]
    pairs = {}
    own = [0] * 1024
    for line in lines:
        for i, u in enumerate(line):
            own[u] += u > 0
            for d in (1, 2):
                for j in (i - d, i + d):
                    if 0 <= j < len(line) and u:
                        key = (d, j < i, line[j], u)
                        pairs[key] = pairs.get(key, 0) + 1
    classes = [max(sum(own[c * side : (c + 1) * side]), 1e-3) for c in range(side)]
    members = [max(own[u], 1e-3 / side) for u in range(1024)]
    member = [members[u] / sum(members[u // side * side : u // side * side + side]) for u in range(1024)]
    p_class = [c / sum(classes) for c in classes]

    def logits(line, i, gains, softmax, c=None):
        out = []
        for k in range(side):
            z = math.log(p_class[k] if softmax == 0 else member[c * side + k])
            for place in (-2, -1, 1, 2):
                d, x = abs(place), line[i + place]
                count = lambda u: pairs.get((d, place < 0, x, u), 0)  # noqa: B023, E731
                if softmax == 0:
                    whole = sum(count(u) for u in range(1024))
                    z += gains[d - 1] * math.log((sum(count(k * side + m) for m in range(side)) / p_class[k] + lm.SHRINK) / (whole + lm.SHRINK))
                else:
                    whole = sum(count(c * side + m) for m in range(side))
                    z += gains[d - 1] * math.log((count(c * side + k) / member[c * side + k] + lm.SHRINK) / (whole + lm.SHRINK))
            out.append(z)
        return out

    def score(k, gains):
        total_, line = 0.0, lines[k]
        for i, w in enumerate(docs[k], 2):
            c, m = divmod(unit[w], side)
            for z, at in ((logits(line, i, gains, 0), c), (logits(line, i, gains, 1, c), m)):
                total_ += z[at] - math.log(sum(map(math.exp, z)))
            if unit[w] > top:
                u = unit[w]
                if counts[w] == 1:
                    total_ += math.log(once[u] / total[u]) - (len(w) + 1) * math.log(257)
                elif w in listed:
                    total_ += math.log(counts[w] / total[u])
                else:
                    total_ += math.log(rest[u] / kinds[u] / total[u])
        return total_

    return score, [sum(counts[w] == 1 for w in d) for d in docs]


def test_language_model_against_brute_force(spark):
    rng = random.Random(11)
    texts = lm_corpus(rng, 60, 1500) + [None, "", " \n ", "word", "long " * 3000]
    texts.append(texts[3])
    for i in range(900):  # more words than own units
        texts.append(f"x{i} x{i}")
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, texts[4], "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, total int").repartition(3)
    model = lm.train(docs)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    score, unseen = brute_scores([t for _, t, *_ in rows])
    for i in (0, 60, 61, 63, 70):
        assert got[i].log_likelihood == pytest.approx(score(i, model.gains), abs=2e-3), i
    assert all(got[i].n_unseen == unseen[k] and got[i].n_words == len((t or "").split()) for k, (i, t, *_) in enumerate(rows))
    assert got[None].log_likelihood == got[4].log_likelihood and got[61].log_likelihood == 0 and got[61].mean_log_likelihood is None
    again = docs.repartition(16)
    other = lm.train(again)
    assert (other.gains == model.gains).all() and other.pairs == model.pairs and other.words.top == model.words.top
    assert all(abs(r.log_likelihood - got[r.doc_id].log_likelihood) < 1e-3 for r in lm.score(again, other).collect())
    assert sorted(map(str, lm.score_corpus(docs).collect())) == sorted(map(str, lm.score(docs, model).collect()))
    assert lm.score(docs.limit(0), lm.train(docs.limit(0))).count() == 0


def test_language_model_beats_word_counts_on_held_out_text(spark):
    rng = random.Random(12)
    seen, held = lm_corpus(rng, 400), lm_corpus(rng, 60)
    docs = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    new = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    for n in (1, 16):
        model = lm.train(docs.repartition(n))
        sums = lambda m: sum(r.log_likelihood for r in lm.score(new, m._replace(unseen=None)).collect())
        words = sum(len(t.split()) for t in held)
        assert sums(model) / words > sums(model._replace(gains=np.zeros(2))) / words + 0.3


def test_language_model_tells_copies_apart(spark):
    rng = random.Random(13)
    texts = lm_corpus(rng, 200)
    docs = spark.createDataFrame([*enumerate(texts), *((500 + i, texts[i]) for i in range(20))], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs)).collect()}
    twice = [got[i].mean_log_likelihood for i in (*range(20), *range(500, 520))]
    alone = sorted(got[i].mean_log_likelihood for i in range(20, 200))
    assert sum(x > alone[162] for x in twice) >= 36 and all(got[i].n_unseen == 0 for i in range(20)) and all(got[i].n_unseen for i in range(20, 200))


def test_language_model_slopes():
    rng = np.random.default_rng(0)
    pairs = rng.poisson(0.3, (2, 64, 64))
    net, gains = lm.Network(pairs), np.array([0.5, 0.3])
    context, target = rng.integers(0, 64, (50, 4)), rng.integers(1, 64, 50)
    net.to_member[:] = 0  # the members' softmax has no part in it
    slope, bend = net.slopes(context, target, gains)
    for d in (0, 1):
        step = np.eye(2)[d] * 1e-2
        f = [net.scaled(g).forward(context, target).sum() for g in (gains + step, gains, gains - step)]
        assert (f[0] - f[2]) / 2e-2 == pytest.approx(slope[d], abs=0.05) and -(f[0] - 2 * f[1] + f[2]) / 1e-4 == pytest.approx(bend[d, d], rel=0.2, abs=1)


@pytest.mark.parametrize("top", [300, 50257, 200_000])
def test_token_blocks(top):
    rng = np.random.default_rng(top)
    docs = [(rng.zipf(1.4, n) % top).astype(np.uint32) for n in (0, 1, 255, 256, 257, 5000, 300_000, 0)] + [np.full(3000, 7, np.uint32), np.array([(1 << 32) - 1], np.uint32)]
    raw = token_coder.encode_segment(list(range(-2, 8)), docs)
    ids, back = token_coder.decode_segment(raw)
    assert ids.tolist() == list(range(-2, 8)) and all(np.array_equal(a, b) for a, b in zip(docs, back, strict=True))
    for at in (-200, len(raw) // 2):
        broken = bytearray(raw)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_coder.decode_segment(bytes(broken))
    assert token_coder.decode_segment(token_coder.encode_segment([1], [np.zeros(0, np.uint32)]))[1][0].size == 0


def test_token_blocks_are_smaller_than_order_0_allows():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    texts = [" ".join(words[min(int(rng.paretovariate(0.7)), 2999)] for _ in range(400)) + "." for _ in range(300)]
    tokens = token_coder.Tokens(public_tokenizers.path("byte_bpe_50k.json")).encode(texts)
    flat = np.concatenate(tokens)
    share = np.bincount(flat)[np.unique(flat)] / len(flat)
    entropy = float(-(share * np.log2(share)).sum())
    assert 8 * len(token_coder.encode_segment(list(range(300)), tokens)) / len(flat) < 0.9 * entropy


def test_token_files(spark, docs, tmp_path, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    more = spark.createDataFrame([(300, "a  b <|endoftext|> c\n\n d e "), (301, "it's\ttabs\x00 nul"), (302, "two\n\nends.\nA b\nc "), (303, "lines\nof 3 words.\nIt's \u00a0 d\u2028e"), (304, "long " * 60_000 + "end")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more)
    token_coder.write_ids(every.selectExpr("*", "'x' as part", "1 as raw", "0 as h", "2 as n_tokens"), f"file://{tmp_path}/ids", path, end_id=2)
    own = Tokenizer.from_file(path)
    rows = sorted(every.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = sorted(token_coder.read_ids(spark, f"file://{tmp_path}/ids", with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_coder.write_ids(every.limit(0), f"file://{tmp_path}/none", path)
    assert token_coder.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_shards_shuffle_the_texts_once(spark):
    """Of the exchanges that lead to the shards, one carries the texts (op3 failed on disk with two)."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed, _, _ = sharding.shuffled(docs, [docs["doc_id"]], 8, 1)
        plan = placed._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

    def exchanges(node) -> int:
        names = [node.output().apply(i).name() for i in range(node.output().size())]
        inner = sum(exchanges(node.children().apply(i)) for i in range(node.children().size()))
        return inner + (node.nodeName() == "Exchange" and "c1" in names)

    assert exchanges(plan) == 1


def test_ego_join_never_shuffles_pairs_of_blocks(spark, monkeypatch):
    """Blocks meet through broadcasts: a shuffle of pairs with their vectors grows with the square of the table."""
    kept, carried = ego_join.materialize, []

    def exchanged(node) -> set:
        own = {node.output().apply(i).name() for i in range(node.output().size())} if node.nodeName() == "Exchange" else set()
        return own.union(*(exchanged(node.children().apply(i)) for i in range(node.children().size())))

    def watch(df, name):
        if name == "pairs":
            carried.append(exchanged(df._jdf.queryExecution().executedPlan().initialPlan()) & {"side_a", "side_b"})
        return kept(df, name)

    monkeypatch.setattr(ego_join, "BLOCK", 8)
    monkeypatch.setattr(ego_join, "CHUNK", 3, raising=False)
    monkeypatch.setattr(ego_join, "materialize", watch)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 12))
    near = np.concatenate([base + 0.08 * rng.normal(size=base.shape) for _ in range(4)]).astype(np.float32)
    got = ego_join.near_duplicates(spark.createDataFrame([(i, x) for i, x in enumerate(near.tolist())], "vec_id long, embedding array<float>")).collect()
    unit = ego_join._unit(near.astype(float))
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist())) and links.sum() > 0
    assert len(carried) > 1 and not set().union(*carried)


def test_dense_groups_below_the_similarity_make_no_pairs(spark, monkeypatch):
    """Near copies whose fingerprints link and whose shingles don't: the result is that of all pairs, and no table of pairs
    is written (the pipeline's near_duplicates failed by a row for each pair)."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"x{rng.random()}"
        return " ".join(out)

    texts = [changed(base, 11) for _ in range(60)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[::6]]
    kept, rows = simhash.materialize, {}

    def watch(df, name):
        out = kept(df, name)
        rows[name] = out[0].count()
        return out

    monkeypatch.setattr(simhash, "materialize", watch)
    monkeypatch.setattr(simhash, "TILE", 9, raising=False)
    monkeypatch.setattr(simhash, "RARE", 4, raising=False)
    label = brute_similar(list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(docs, distance=68, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert len(set(r.component_id for r in got)) == 60
    assert max(rows.values()) <= 4 * len(texts)


def test_a_tile_of_links_is_compared_in_little_memory():
    """Counts and links of 2048 similar documents: at most 16 bytes for each two of them are held at once (72 before)."""
    n, m = 2048, 60
    values = np.random.default_rng(5).integers(0, 1 << 62, m + n)
    sets = [np.sort(np.append(values[:m], values[m + i])) for i in range(n)]
    rows = pa.table({"node": np.arange(n), "label": np.arange(n), "size": np.full(n, m + 1), "shingles": pa.array(sets, pa.list_(pa.int64()))})
    tracemalloc.start()
    try:
        found = simhash._within(0.8)(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(found["u"].to_pylist()) == list(range(1, n)) and set(found["v"].to_pylist()) == {0}
    assert most < 16 * n * n, most
    apart = simhash._within(0.99)(rows)
    assert apart.num_rows == 0


def test_tokens_are_those_of_the_library():
    """Stretches asked for side by side, and white space that is neither a space nor a line end: a no-break space beside a
    line end was cut from it, which the library does not do."""
    import public_tokenizers

    tokens = token_coder.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["a", "'s", " ", "\n", "\xe9", "<|endoftext|>", "1", "|", "the", "\xa0", "\u65e5", "\x85", "\r", "\t", "\u2028", "\x1c", "\u3000", "\xad"]
    texts = ["", " ", "\n", "a\n\xa0b", "'s\n\xa0\xa0\xe9", "a\n\u3000b c", "a <|endoftext|> b", " a", "a ", "\0", "a\0b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(1000)]
    texts += [" ".join(rng.choice(["the", "of", "x|", "\xe9t\xe9", "\u65e5\u672c", "don't", "<|endoftext|>"]) + str(rng.randint(0, 300)) for _ in range(50)) + "\nEnd." for _ in range(20)]
    for _ in range(2):
        got = tokens.encode(texts)
        assert [x.tolist() for x in got] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

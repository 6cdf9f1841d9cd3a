"""Suffix-array dedup on a run-length index.

A byte goes if it lies in a string of MATCH bytes that also starts in a document with a smaller id.

1. Each window of MATCH bytes takes the smallest hash of its K-byte strings, its anchor.  Equal windows have equal anchors.
   A run is a stretch of windows with one anchor (RUN windows at most).  Runs meet by anchor: hashes only, no text.  Of runs
   with one hash the one in the smallest document is the first, the others are its followers; repeats within a map batch are
   told before they are dealt out.  A first without followers whose anchor one document alone has is done with.
2. The firsts are indexed: one run for each distinct string that has followers or whose anchor several documents share.  They
   meet by anchor in buckets.  Each bucket builds a suffix array of its strings, the run-length compressed Burrows-Wheeler transform, and
   samples the common prefix with the suffix before at the ends of the runs only; matching statistics of all other positions
   stream from these samples, in text order, one less for each step.  Suffixes with MATCH bytes in common are one group, and
   every window whose group has a smaller document is marked.  For each indexed string that has followers the bucket tells
   its digest (64 bits more of its bytes) and the smallest document of its windows; followers meet these by their own digests, and
   those in greater documents are marked as a whole.
3. Marks meet the texts and bytes go.

An anchor with more than HOT distinct runs is dealt out window by window, by the window's own hash, so no bucket grows with
a common string; its followers' digest is then told by a bucket of its own.  Nothing is removed that no index has answered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets_for, drop, materialize, release, spread_join, text_bytes, text_slices

MATCH, K, RUN, HOT = 50, 24, 64, 4096
#: Bytes of input for each bucket of anchors.
BUCKET_BYTES = 8 << 20
_SLICE, _HELD = 1 << 18, 8 << 20
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Replies: a follower; a first; a first of a hot anchor, without and with followers; bit 2: the first has followers.
_FOLLOWS, _SHIPPED, _HOT, _SHARED = 0, 1, 2, 4
_FLAG = 1 << 30  # in an ordinal: the run has followers in its batch
_TABLE = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OCTETS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _power or len(_power[0]) < n:
        base, size, powers = 0x5851F42D4C957F2D, max(n, _SLICE * 2), []
        for b in (base, pow(base, -1, 1 << 64)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            powers.append(np.cumprod(factors))
        _power[:] = powers
    return _power[0], _power[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _C3
    x ^= x >> np.uint64(32)
    return x


class Runs:
    """The runs of the documents in one slice of texts: document, ordinal in it, first window, windows, anchor, hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, hashes: bool = True):
        n = len(data)
        lengths = np.diff(offsets)
        long = np.flatnonzero(lengths >= MATCH)
        if not len(long):
            self.doc = self.ordinal = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.uint64)
            return
        m = n - K + 1
        padded = data if n >= 8 else np.concatenate([data, np.zeros(8, np.uint8)])
        loads = np.ndarray((n - 7,), np.uint64, padded, 0, (1,))
        h = loads[:m] * _C1
        for at in range(8, K, 8):
            h ^= h >> np.uint64(31)
            h += loads[at : at + m] * _C2
            h *= _C1
        h = _mix(h)
        size = 1
        width = MATCH - K + 1
        while size < width:
            step = min(size, width - size)
            h = np.minimum(h[:-step], h[step:])
            size += step
        first, last = offsets[long], offsets[long + 1] - MATCH + 1
        begins = np.zeros(len(h) + 1, bool)
        begins[1:-1] = h[1:] != h[:-1]
        begins[first] = True
        valid = np.zeros(len(h) + 1, np.int8)
        np.add.at(valid, first, 1)
        np.add.at(valid, last, -1)
        inside = np.cumsum(valid, dtype=np.int8).astype(bool)
        start = np.flatnonzero(begins & inside)
        which = np.searchsorted(first, start, "right") - 1
        count = np.minimum(np.append(start[1:], len(h)), last[which]) - start
        parts = -(-count // RUN)
        if (parts > 1).any():
            at = np.repeat(np.arange(len(start)), parts)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, which = start[at] + inner * RUN, which[at]
            count = np.minimum(RUN, count[at] - inner * RUN)
        self.doc, self.start, self.count, self.anchor = long[which], start, count, h[start]
        heads = np.searchsorted(which, np.arange(len(long)), "left")
        self.ordinal = np.arange(len(start)) - heads[which]
        if hashes:
            power, inverse = _powers(n + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[:n])])
            self.hash = _mix(((sums[start + count + MATCH - 1] - sums[start]) * inverse[start]) ^ (count.astype(np.uint64) * _C1))


def _pack(anchor: np.ndarray, hashes: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> bytes:
    """Anchors' low 32 bits and 48 bits of the hashes as they are; ids and ordinals by octet planes, compressed."""
    planes = np.concatenate([doc.view(np.uint8).reshape(-1, 8).T.ravel(), ordinal.astype(np.int32).view(np.uint8).reshape(-1, 4).T.ravel()])
    return np.int64(len(doc)).tobytes() + anchor.astype(np.uint32).tobytes() + (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (hashes >> np.uint64(48)).astype(np.uint16).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    anchor = np.frombuffer(blob, np.uint32, n, 8)
    hashes = np.frombuffer(blob, np.uint32, n, 8 + 4 * n).astype(np.uint64) | (np.frombuffer(blob, np.uint16, n, 8 + 8 * n).astype(np.uint64) << np.uint64(32))
    planes = np.frombuffer(pa.decompress(blob[8 + 10 * n :], 12 * n, "zstd", asbytes=True), np.uint8)
    doc = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.int64).ravel()
    ordinal = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.int32).ravel()
    return anchor, hashes, doc, ordinal


_REPLY = np.dtype([("doc", "<i8"), ("ordinal", "<i4"), ("anchor", "<u4"), ("code", "<u1")])


def _cut_at(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Rows in order of their keys as one blob for each key."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    ends = np.append(first, len(key)) * rows.dtype.itemsize
    return key[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _replies(doc: np.ndarray, ordinal: np.ndarray, anchor: np.ndarray, code: np.ndarray, groups: int) -> tuple[np.ndarray, pa.Array]:
    """One blob of replies for each group of documents."""
    rows = np.empty(len(doc), _REPLY)
    rows["doc"], rows["ordinal"], rows["anchor"], rows["code"] = doc, ordinal, anchor.astype(np.uint32), code
    return _cut_at(rows, (_mix(doc.astype(np.int64).view(np.uint64) * _C1) % np.uint64(groups)).astype(np.int64))


def _by_document(rows: pa.Table) -> pa.Table:
    """The replies of a group of documents, one blob for each document."""
    told = np.frombuffer(b"".join(b.as_py() for b in rows["blob"]), _REPLY)
    keys, blobs = _cut_at(told, told["doc"])
    return pa.table({"key": pa.array(keys), "replies": blobs})


def _firsts(anchor: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (anchor, hash, doc), where in it each string starts, and each place's string."""
    order = np.lexsort((doc, hashes, anchor))
    a, h = anchor[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _scatter(n_buckets: int):
    """Documents to (kind, key, blob): kind 0, runs for bucket `key`; kind 1, replies for the group `key` of documents."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Runs of about _HELD bytes of texts at a time."""
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, offsets, data in text_slices(batch.column(1), _SLICE):
                runs = Runs(offsets, data)
                if len(runs.doc):
                    parts.append((runs.anchor, runs.hash, ids[row + runs.doc], runs.ordinal))
                size += len(data)
                if size > _HELD and parts:
                    yield parts
                    parts, size = [], 0
        if parts:
            yield parts
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in held(batches):
            anchor, hashes, doc, ordinal = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first, string = _firsts(anchor, hashes, doc)
            covered = doc[order] != doc[order[first]][string]
            at = order[covered]
            keys, blobs = _replies(doc[at], ordinal[at], anchor[at], np.full(len(at), _FOLLOWS, np.uint8), n_buckets)
            ordinal[order[first[np.unique(string[covered])]]] |= _FLAG
            at = np.sort(order[~covered])
            bucket = ((anchor[at] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            at, bucket = at[by], bucket[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            packed = [_pack(anchor[x], hashes[x], doc[x], ordinal[x]) for x in (at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(packed), np.int32)), pa.array(bucket[cuts[:-1]]), pa.array(packed, pa.binary())], ["kind", "key", "blob"])
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), blobs], ["kind", "key", "blob"])

    return run


def _meet(rows: pa.Table, groups: int) -> pa.Table:
    """The replies of a bucket of runs."""
    anchor, hashes, doc, ordinal = (np.concatenate(x) for x in zip(*(_unpack(b.as_py()) for b in rows["blob"]), strict=True))
    order, first, string = _firsts(anchor, hashes, doc)
    covered = doc[order] != doc[order[first]][string]
    flagged = (ordinal & _FLAG) > 0
    ordinal = ordinal & ~np.int32(_FLAG)
    shared = np.zeros(len(first), bool)
    shared[string[covered | flagged[order]]] = True
    a = anchor[order[first]]
    new = np.concatenate([[True], a[1:] != a[:-1]])
    head = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    low = np.minimum.reduceat(doc[order[first]], head)
    high = np.maximum.reduceat(doc[order[last]], head)
    kinds = np.diff(np.append(head, len(first)))
    group = np.cumsum(new) - 1
    code = np.where((kinds == 1) | (low == high), 255, np.where(kinds > HOT, _HOT, _SHIPPED))[group]
    code = np.where(shared, np.where(code == 255, _SHIPPED, code) | _SHARED, code).astype(np.uint8)[string]
    # one holder is enough to index a string; windows of other holders in the same document are the same
    code[covered] = _FOLLOWS
    told = code != 255
    at = order[told]
    keys, blobs = _replies(doc[at], ordinal[at], anchor[at], code[told], groups)
    return pa.table({"key": pa.array(keys), "blob": blobs})


def _merge(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Intervals as rows, those that overlap or touch made one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return np.stack([s[first], e[np.append(first[1:], len(s)) - 1]], 1).astype(np.int64)


def _digests(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    return pa.array(np.fromiter((digest(view[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(start)).view(np.int64))


#: Columns of strings and followers; a follower has a digest and a size, a string its octets.
_TAKEN = ["bucket", "doc_id", "text_hash", "at", "size", "shared", "digest", "body"]


def _take(n_buckets: int):
    """Documents with replies to rows: bucket -1, a follower with its digest and its place; else a string for that bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            texts, replies = batch.column(2), batch.column(3)
            for row, offsets, data in text_slices(texts, _SLICE):
                runs = Runs(offsets, data, hashes=False)
                heads = np.searchsorted(runs.doc, np.arange(len(offsets)), "left")
                picked, codes = [], []
                for d in range(len(offsets) - 1):
                    told = np.frombuffer(replies[row + d].as_py(), _REPLY)
                    told = told[told["ordinal"] < heads[d + 1] - heads[d]]
                    at = heads[d] + told["ordinal"]
                    same = runs.anchor[at].astype(np.uint32) == told["anchor"]
                    picked.append(at[same])
                    codes.append(told["code"][same])
                at, code = np.concatenate(picked), np.concatenate(codes)
                if not len(at):
                    continue

                def rows(bucket: np.ndarray, doc: np.ndarray, start: np.ndarray, size: pa.Array, shared: np.ndarray, digest: pa.Array, body: pa.Array) -> pa.RecordBatch:
                    at = pa.array((start - offsets[doc]).astype(np.int32))  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids[row + doc]), pa.array(marks[row + doc]), at, size, pa.array(shared), digest, body], _TAKEN)  # noqa: B023

                own = at[code == _FOLLOWS]
                for k in range(0, len(own), 20_000):
                    part = own[k : k + 20_000]
                    doc, start, size = runs.doc[part], runs.start[part], runs.count[part] + MATCH - 1
                    yield rows(np.full(len(part), -1), doc, start, pa.array(size.astype(np.int32)), np.zeros(len(part), bool), _digests(data, start, size), pa.nulls(len(part), pa.binary()))
                kind, shared = code & 3, (code & _SHARED) > 0
                hot = kind == _HOT
                whole, alone = kind == _SHIPPED, hot & shared
                at, shared = np.concatenate([at[whole], at[alone], at[hot]]), np.concatenate([shared[whole], shared[alone], np.zeros(hot.sum(), bool)])
                cut = np.arange(len(at)) >= len(at) - hot.sum()  # one string for each window
                key = runs.anchor[at] >> np.uint64(7)
                start, size, doc = runs.start[at], runs.count[at] + MATCH - 1, runs.doc[at]
                power, inverse = _powers(len(data) + 1)
                if hot.any():
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * power[: len(data)])])
                    spread = slice(int(whole.sum()), len(at) - int(hot.sum()))
                    key[spread] = _mix((sums[start[spread] + size[spread]] - sums[start[spread]]) * inverse[start[spread]])
                    count = runs.count[at[cut]]
                    of = np.repeat(np.flatnonzero(cut), count)
                    begin = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                    by_window = _mix((sums[begin + MATCH] - sums[begin]) * inverse[begin])
                    key, start, size, doc, shared = np.concatenate([key[~cut], by_window]), np.concatenate([start[~cut], begin]), np.concatenate([size[~cut], np.full(len(of), MATCH)]), np.concatenate([doc[~cut], doc[of]]), np.concatenate([shared[~cut], np.zeros(len(of), bool)])
                for k in range(0, len(key), 20_000):
                    part = slice(k, k + 20_000)
                    length = size[part]
                    ends = np.concatenate([[0], np.cumsum(length)])
                    chars = data[np.repeat(start[part] - ends[:-1], length) + np.arange(ends[-1])]
                    body = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(chars)])
                    yield rows((key[part] % np.uint64(n_buckets)).astype(np.int64), doc[part], start[part], pa.nulls(len(length), pa.int32()), shared[part], pa.nulls(len(length), pa.int64()), body)

    return run


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(key)
    step = np.ones(len(key), bool)
    ordered = key[order]
    step[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(step)
    return rank


class RunLengthIndex:
    """An index of the suffixes of strings that have MATCH bytes or more.

    suffix: places of the suffixes, in order of their first MATCH bytes.  A run of the transform is a stretch of suffixes with
    one byte before them whose images, a byte longer, stand side by side too; only at the ends of runs is the common prefix
    with the suffix before measured.  matching: that length for every place, streamed from the samples in text order."""

    def __init__(self, lengths: np.ndarray, chars: np.ndarray):
        n = len(chars)
        ends = np.cumsum(lengths)
        counts = lengths - MATCH + 1
        #: The string of each suffix, its place in the text, and its bytes.
        self.string = np.repeat(np.arange(len(lengths)), counts)
        self.place = np.arange(len(self.string)) + np.repeat(ends - lengths - np.cumsum(counts) + counts, counts)
        self.rest = ends[self.string] - self.place
        text = np.concatenate([chars, np.zeros(MATCH + 8, np.uint8)])
        loads = np.ndarray((n,), ">u8", text, 0, (1,)).astype(np.uint64)
        ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), np.int64)])[:n]
        rank = _ranks(loads)
        rank = _ranks(rank * (n + 1) + ahead(rank, 8))  # of 16 bytes
        later = np.zeros(n, bool)
        later[self.place] = True
        later[self.place + (MATCH - 32)] = True
        need = np.flatnonzero(later)
        of32 = np.zeros(n, np.int64)
        of32[need] = _ranks(rank[need] * (n + 1) + ahead(rank, 16)[need])
        key = of32[self.place] * (n + 1) + of32[self.place + (MATCH - 32)]  # 32 bytes, then the last 32 of MATCH
        self.suffix = np.argsort(key)
        row = np.empty(len(key), np.int64)
        row[self.suffix] = np.arange(len(key))
        starts = np.zeros(len(key), bool)
        starts[np.cumsum(counts) - counts] = True
        before = np.where(starts, 0, text[self.place - 1].astype(np.int64) + 1)
        a, b = self.suffix[1:], self.suffix[:-1]
        inner = (before[a] == before[b]) & (before[a] > 0)
        inner[inner] = row[a[inner] - 1] == row[b[inner] - 1] + 1
        rows = np.flatnonzero(~inner)
        a, b = a[rows], b[rows]
        most = np.minimum(self.rest[a], self.rest[b])
        p, q = self.place[a], self.place[b]
        common, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            at = common[live]
            x = loads[np.minimum(p[live] + at, n - 1)] ^ loads[np.minimum(q[live] + at, n - 1)]
            same = 8 - np.searchsorted(_OCTETS, x, "right")
            common[live] = np.minimum(at + same, most[live])
            live = live[(same == 8) & (at + 8 < most[live])]
        sampled, value = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        sampled[self.suffix[0]] = True
        sampled[a] = True
        value[a] = common
        last = np.maximum.accumulate(np.where(sampled, np.arange(len(key)), 0))
        self.matching = value[last] - (np.arange(len(key)) - last)


def marked(lengths: np.ndarray, chars: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset) of each window of MATCH bytes that also is in a string of a smaller document; and for each string the
    greatest of its windows' smallest documents."""
    index = RunLengthIndex(lengths, chars)
    order = index.suffix
    new = np.ones(len(order), bool)
    new[1:] = index.matching[order[1:]] < MATCH
    first = np.flatnonzero(new)
    owner = doc[index.string]
    low = np.minimum.reduceat(owner[order], first)
    least = np.empty(len(order), doc.dtype)
    least[order] = low[np.cumsum(new) - 1]
    hit = np.flatnonzero(owner > least)
    starts = np.cumsum(lengths) - lengths
    most = np.full(len(lengths), np.iinfo(np.int64).min)
    np.maximum.at(most, index.string, least)
    return index.string[hit], index.place[hit] - starts[index.string[hit]], most


def _match(rows: pa.Table) -> pa.Table:
    """What a bucket's index tells: marked stretches of its strings, span being the start and the end, 32 bits each; and for each
    string that has followers its digest, and in doc_id the document that theirs must be greater than."""
    rows = rows.combine_chunks()
    body = rows["body"].combine_chunks()
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    chars = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    doc, text_hash, at = (rows[c].to_numpy() for c in ("doc_id", "text_hash", "at"))
    string, place, most = marked(np.diff(offsets), chars, doc)
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    s = at[string[first]] + place[first] if len(string) else np.zeros(0, np.int64)
    e = at[string[last]] + place[last] + MATCH if len(string) else np.zeros(0, np.int64)
    shared = np.flatnonzero(rows["shared"].to_numpy())
    told = _digests(chars, offsets[:-1][shared] - offsets[0], np.diff(offsets)[shared])
    marks = {"doc_id": pa.array(doc[string[first]]), "text_hash": pa.array(text_hash[string[first]]), "span": pa.array((s << 32) | e), "digest": pa.nulls(len(first), pa.int64())}
    confirms = {"doc_id": pa.array(most[shared]), "text_hash": pa.nulls(len(shared), pa.int64()), "span": pa.nulls(len(shared), pa.int64()), "digest": told}
    return pa.concat_tables([pa.table(marks), pa.table(confirms)])


def _spans(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text_hash, span): stretches to remove, start and end as 32 bits each."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and octet_length(text) >= " + str(MATCH))
    n_buckets = buckets_for(docs, BUCKET_BYTES)
    dealt = body.mapInArrow(_scatter(n_buckets), "kind int, key long, blob binary")
    key = F.when(F.col("kind") == 0, F.col("key")).otherwise(F.lit(-1) - F.pmod("key", F.lit(n_buckets)))

    def answer(rows: pa.Table) -> pa.Table:
        return rows.select(["key", "blob"]) if rows["kind"][0].as_py() else _meet(rows, n_buckets)

    replies, replies_at = materialize(dealt.withColumn("group", key).groupBy("group").applyInArrow(answer, "key long, blob binary"), "replies")
    told = replies.groupBy("key").applyInArrow(_by_document, "key long, replies binary")
    rows = body.join(told, body.doc_id == told.key).select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "replies")
    schema = "bucket long, doc_id long, text_hash long, at int, size int, shared boolean, digest long, body binary"
    taken, _ = materialize(rows.mapInArrow(_take(4 * n_buckets), schema), "strings")
    drop(spark, replies_at)
    matched = taken.where("bucket >= 0").groupBy("bucket").applyInArrow(_match, "doc_id long, text_hash long, span long, digest long")
    matched, _ = materialize(matched, "marks")
    follows = taken.where("bucket < 0").select("doc_id", "text_hash", "at", "size", "digest")
    # a string may be told by several holders of one document, and of hot anchors by more than one bucket
    known = matched.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    known = known.join(follows.groupBy("digest").agg(F.count("*").alias("n")), "digest")
    start = F.col("at").cast("long")
    covered = spread_join(follows, known, ["digest"]).where("doc_id > least").select("doc_id", "text_hash", (F.shiftleft(start, 32) + start + F.col("size")).alias("span"))
    return matched.where("digest is null").select("doc_id", "text_hash", "span").unionByName(covered)


def _with_spans(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """All rows of docs as (doc, id, text, spans); spans: an array or null."""
    spans = _spans(docs, text, doc_id).groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("spans"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("doc"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    return rows.join(spans, (rows.id == spans.doc_id) & (rows.mark == spans.text_hash), "left").select("doc", "id", "text", "spans")


def _cut(text: bytes | None, spans: list[int] | None) -> tuple[bytes, int, int]:
    """What remains of a text, how many bytes go, and in how many stretches."""
    text = text or b""
    if not spans:
        return text, 0, 0
    both = np.array(spans)
    whole = _merge(both >> 32, both & 0xFFFFFFFF)
    out, at = [], 0
    for s, e in whole.tolist():
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out), int((whole[:, 1] - whole[:, 0]).sum()), len(whole)


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Null texts count as empty; texts shorter than MATCH bytes lose nothing.  Rows with one id are one document: they remove
    nothing from each other, and each gets what is removed from its own text.  A row without an id has no order: it loses
    nothing and removes nothing.  An empty table gives no rows.  Texts are bytes: a character may lose some of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(text_bytes(batch.column(1)), batch.column(2), strict=True):
                kept, gone, n = _cut(body, spans.as_py())
                rows.append((len(body or b""), gone, n, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    return _with_spans(docs, text, doc_id).select(F.col("doc")[doc_id].alias("doc_id"), "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with what repeats() removes cut out of the texts; of a character that is cut through, the rest goes too.

    Texts that lose nothing stay as they are, null included.  A document that loses all keeps its row, with an empty text.
    Rows without an id lose nothing; repeated rows lose the same.  An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if body is None else _cut(body, spans.as_py())[0].decode("utf-8", "ignore") for body, spans in zip(text_bytes(batch.column(1)), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], ["doc", "text"])

    rows = _with_spans(docs, text, doc_id).select("doc", "text", "spans")
    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])

"""Token ids in files: an adaptive context-mixing range coder in independent, checksummed blocks.

Three predictions are mixed for each id of a block.  Order 2: the id that last followed the last two ids in this block.
Order 1: the distribution of the ids that follow the last one.  Order 0: the distribution of all ids.  The weight of order 2
comes from two adaptive probabilities, one for each confidence of the prediction and one for the block; the weight of order 0
against order 1 comes from the last id's own share of rare successors and from an adaptive probability of the block.  The
distributions of orders 0 and 1 are counted over the segment and stand in its head, with successors that occur once left to
order 0.  Each block starts anew from the head alone and carries the CRC-32 of its ids; the head has one too.

Blocks of a segment are coded side by side, one numpy operation for all of them: a segment holds whole documents, in order.

Segment: magic `TKS2`; documents, blocks, bytes of the head, CRC-32 of the head as unsigned 32-bit integers; each document's
id (signed 64-bit) and tokens (unsigned 32-bit); each block's tokens, words and CRC-32; the head; then the blocks' 32-bit
words.  All is little endian.  Segments are the rows of a Parquet table, in order of (part, segment).
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release

#: Ids of a block at most, of a segment (about), and slots of a block's order-2 table.  A segment has 512 blocks at least, if
#: that leaves them 256 ids: one step of numpy serves them all.
BLOCK, SEGMENT, SLOTS = 4096, 1 << 22, 1 << 12
#: Bits of the mixing weights.  Successors of an id that occur less often than LEAST are left to order 0.
MIX, LEAST = 12, 2
KEPT = 1 << 18
#: New stretches that the library is asked for as one text, and characters of texts that are encoded at once, about.
TOGETHER, AT_ONCE = 64, 4 << 20
_ONE = 1 << MIX
_LOW = np.uint64(32)
_ROOM = np.uint64(1 << 32)
#: Counts are kept as multiples of an eighth of a power of two.
_COUNTS = np.round(2.0 ** (np.arange(256) / 8)).astype(np.int64)


def _coded(counts: np.ndarray) -> np.ndarray:
    """The code of each count, one octet."""
    return np.clip(np.round(8 * np.log2(np.maximum(counts, 1))), 0, 255).astype(np.uint8)


def _scaled(counts: np.ndarray, row: np.ndarray, rows: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of at least 1 that add up to total in each row, and the cumulative frequency before each in its row."""
    kinds = np.bincount(row, minlength=rows)
    sums = np.bincount(row, counts, rows).astype(np.int64)
    free = 1 + counts * (total - kinds[row]) // np.maximum(sums[row], 1)
    first = np.cumsum(kinds) - kinds
    some = kinds > 0
    free[first[some]] += total - np.bincount(row, free, rows).astype(np.int64)[some]
    before = np.cumsum(free) - free
    return free, before - before[first[row]]


class _Head:
    """Orders 0 and 1 of a segment.  Ids are their ranks among the segment's ids; rank `kinds` is the start of a block."""

    def __init__(self, raw: bytes):
        kinds, pairs, size = np.frombuffer(raw, "<u4", 3).tolist()
        flat = pa.decompress(raw[12:], size, "zstd", asbytes=True)
        sizes = [4 * kinds, kinds, 4 * (kinds + 1), kinds + 1, 4 * pairs, pairs]
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        wide = lambda k, n: np.ascontiguousarray(np.frombuffer(flat, np.uint8, 4 * n, at[k]).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
        octets = lambda k, n: np.frombuffer(flat, np.uint8, n, at[k]).astype(np.int64)
        self.kinds, self.bits = kinds, max(16, int(kinds).bit_length() + 1)
        if self.bits + MIX > 32:
            raise ValueError("a segment has too many different ids")
        total = 1 << self.bits
        self.ids = np.cumsum(wide(0, kinds))
        self.freq0, self.cum0 = _scaled(_COUNTS[octets(1, kinds)], np.zeros(kinds, np.int64), 1, total)
        lengths = wide(2, kinds + 1)
        self.row = np.repeat(np.arange(kinds + 1), lengths)
        step = wide(4, pairs)
        whole = np.cumsum(step)
        first = np.cumsum(lengths) - lengths
        base = np.concatenate([[0], whole])[first]
        self.next = whole - base[self.row]
        self.freq1, self.cum1 = _scaled(_COUNTS[octets(5, pairs)], self.row, kinds + 1, total)
        #: The share of order 0 after each id, of _ONE; all of it where no successor is kept.
        self.rare = np.where(lengths > 0, octets(3, kinds + 1) * (_ONE // 256), _ONE).astype(np.int32)
        self.key = self.row * (kinds + 1) + self.next
        self.at0 = self.cum0
        self.at1 = (self.row << self.bits) + self.cum1

    @classmethod
    def of(cls, ids: np.ndarray, before: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> bytes:
        """The head for ranks `ids`, each after the rank `before`, of the different ids `kinds`."""
        n = len(kinds)
        keys = np.sort(before * (n + 1) + ids)
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(np.append(cut, len(keys))), keys[cut]
        row = keys // (n + 1)
        every, kept = np.bincount(row, times, n + 1), times >= LEAST
        rare = np.bincount(row[~kept], times[~kept], n + 1)
        share = np.clip(np.round(256 * rare / np.maximum(every, 1)), 1, 255).astype(np.uint8)
        row, times, after = row[kept], times[kept], keys[kept] % (n + 1)
        step = np.where(np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool), after, np.diff(after, prepend=0))
        wide = lambda x: np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
        flat = wide(np.diff(kinds.astype(np.int64), prepend=0)) + _coded(counts).tobytes() + wide(np.bincount(row, minlength=n + 1)) + share.tobytes() + wide(step) + _coded(times).tobytes()
        return np.array([n, len(row), len(flat)], "<u4").tobytes() + pa.compress(flat, "zstd", asbytes=True)


class _Model:
    """The adaptive side: order 2 and the mixing weights of all blocks of a segment."""

    def __init__(self, lanes: int, head: _Head):
        self.head = head
        self.lane = np.arange(lanes)
        self.base, self.quad = self.lane * SLOTS, self.lane * 4
        #: Of each slot: rank + 1 in the upper bits, confidence in the lower two; 0 if empty.
        self.second = np.zeros(lanes * SLOTS, np.uint32)
        self.by_trust = np.tile(np.array([256, 1024, 2048, 3584], np.int32), lanes)
        self.by_block, self.rare = np.full(lanes, 512, np.int32), np.full(lanes, 256, np.int32)
        self.last, self.before = np.full(lanes, head.kinds, np.uint32), np.full(lanes, head.kinds, np.uint32)
        self.shift = np.uint32(32 - SLOTS.bit_length() + 1)

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The weights, of _ONE, of order 2 and of orders 2 and 1, for the first n blocks."""
        last = self.last[:n]
        self.at = self.base[:n] + ((last * np.uint32(2654435761) + self.before[:n] * np.uint32(2246822519)) >> self.shift)
        cell = self.second[self.at]
        self.guess = (cell >> np.uint32(2)) - np.uint32(1)
        self.trust = cell & np.uint32(3)
        self.context = self.quad[:n] + self.trust
        self.own = self.by_trust[self.context]
        two = np.where(cell > 0, np.maximum((self.own + self.by_block[:n]) >> 1, 16), 0)
        rare = self.head.rare[last]
        none = ((_ONE - two) * ((3 * rare + self.rare[:n]) >> 2)) >> MIX
        none = np.where(rare == _ONE, _ONE - two, np.minimum(np.maximum(none, 1), _ONE - 1 - two))
        return two.astype(np.int64), (_ONE - none).astype(np.int64)

    def update(self, ids: np.ndarray, case: np.ndarray) -> None:
        """case: 0 for order 2, 1 for order 1, 2 for order 0."""
        n = len(ids)
        hit = case == 0
        goal = hit.astype(np.int32) << MIX
        self.by_trust[self.context] = self.own + ((goal - self.own) >> 4)
        self.by_block[:n] += (goal - self.by_block[:n]) >> 6
        rare = self.rare[:n]
        rare += np.where(hit, 0, ((case == 2).astype(np.int32) * _ONE - rare) >> 6)
        self.second[self.at] = (ids + np.uint32(1) << np.uint32(2)) | np.where(hit, np.minimum(self.trust + np.uint32(1), np.uint32(3)), np.uint32(0))
        self.before[:n], self.last[:n] = self.last[:n], ids


def _encode_lanes(ids: np.ndarray, pair: np.ndarray, lasts: int, head: _Head) -> tuple[np.ndarray, np.ndarray]:
    """32-bit words of each block, and how many.  ids: a row for each step, a column for each block; the last block has
    `lasts` ids.  pair: the place of (id before, id) in the head's order 1, or -1."""
    steps, lanes = ids.shape
    model, bits = _Model(lanes, head), np.uint64(head.bits + MIX)
    freq0, cum0 = head.freq0, head.cum0
    freq1, cum1 = np.append(head.freq1, 0), np.append(head.cum1, 0)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0), np.uint64)
    out, used = np.zeros((lanes, steps + 4), np.uint32), np.zeros(lanes, np.int64)

    def emit(at: np.ndarray) -> None:
        out[at, used[at]] = (low[at] >> _LOW).astype(np.uint32)
        used[at] += 1
        low[at] <<= _LOW

    for t in range(steps):
        n = lanes if t < lasts else lanes - 1
        x, at1 = ids[t, :n], pair[t, :n]
        two, one = model.weights(n)
        case = np.where(x == model.guess, 0, np.where(at1 >= 0, 1, 2))
        share = np.where(case == 1, one - two, _ONE - one)
        start = np.where(case == 0, 0, np.where(case == 1, (two << head.bits) + share * cum1[at1], (one << head.bits) + share * cum0[x])).astype(np.uint64)
        size = np.where(case == 0, two << head.bits, share * np.where(case == 1, freq1[at1], freq0[x])).astype(np.uint64)
        step = span[:n] >> bits
        start *= step
        low[:n] += start
        carry = np.flatnonzero(low[:n] < start)
        if len(carry):
            place = used[carry] - 1
            while len(carry):
                out[carry, place] += np.uint32(1)
                more = out[carry, place] == 0
                carry, place = carry[more], place[more] - 1
        span[:n] = size * step
        tight = np.flatnonzero(span[:n] < _ROOM)
        if len(tight):
            emit(tight)
            span[tight] <<= _LOW
        model.update(x, case)
    for _ in range(2):
        emit(np.arange(lanes))
    return out, used


def _decode_lanes(words: np.ndarray, steps: int, lasts: int, head: _Head) -> np.ndarray:
    """The ranks again, a row for each step."""
    lanes = len(words)
    model, bits = _Model(lanes, head), np.uint64(head.bits + MIX)
    span = np.full(lanes, ~np.uint64(0), np.uint64)
    words = np.concatenate([words, np.zeros((lanes, 3), np.uint32)], 1).astype(np.uint64)
    code = words[:, 0] << _LOW | words[:, 1]
    used, most = np.full(lanes, 2), words.shape[1] - 1
    ids = np.zeros((steps, lanes), np.uint32)
    top = np.uint64((1 << head.bits + MIX) - 1)
    at1 = np.concatenate([head.at1, [(head.kinds + 2) << head.bits]])
    for t in range(steps):
        n = lanes if t < lasts else lanes - 1
        two, one = model.weights(n)
        step = span[:n] >> bits
        value = np.minimum(code[:n] // step, top).astype(np.int64)
        high = value >> head.bits
        case = (high >= two).astype(np.int64) + (high >= one)
        x, start, size = model.guess.astype(np.int64), np.zeros(n, np.int64), two << head.bits
        k = np.flatnonzero(case == 1)
        if len(k):
            share, begin = (one - two)[k], two[k] << head.bits
            j = np.searchsorted(at1, (model.last[k].astype(np.int64) << head.bits) + (value[k] - begin) // share, "right") - 1
            x[k], start[k], size[k] = head.next[j], begin + share * head.cum1[j], share * head.freq1[j]
        k = np.flatnonzero(case == 2)
        if len(k):
            share, begin = (_ONE - one)[k], one[k] << head.bits
            j = np.searchsorted(head.at0, (value[k] - begin) // share, "right") - 1
            x[k], start[k], size[k] = j, begin + share * head.cum0[j], share * head.freq0[j]
        code[:n] -= start.astype(np.uint64) * step
        span[:n] = size.astype(np.uint64) * step
        tight = np.flatnonzero(span[:n] < _ROOM)
        if len(tight):
            code[tight] = code[tight] << _LOW | words[tight, np.minimum(used[tight], most)]
            used[tight] += 1
            span[tight] <<= _LOW
        ids[t, :n] = x
        model.update(ids[t, :n], case)
    return ids


def _ranks(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, how often each occurs, and each id's rank among them."""
    if int(flat.max()) < 1 << 22:
        counts = np.bincount(flat)
        kinds = np.flatnonzero(counts)
        rank = np.zeros(len(counts), np.int64)
        rank[kinds] = np.arange(len(kinds))
        return kinds, counts[kinds], rank[flat]
    kinds, rank, counts = np.unique(flat, return_inverse=True, return_counts=True)
    return kinds.astype(np.int64), counts, rank.astype(np.int64)


def encode_segment(doc_ids: list[int], tokens: list[np.ndarray]) -> bytes:
    """One segment of whole documents.  More than half a million different ids in one segment raise ValueError."""
    flat = np.concatenate(tokens).astype(np.uint32) if tokens else np.zeros(0, np.uint32)
    block = min(BLOCK, max(256, len(flat) // 512))
    lanes = -(-len(flat) // block)
    front = np.array(doc_ids, "<i8").tobytes() + np.array([len(t) for t in tokens], "<u4").tobytes()
    if not lanes:
        return b"TKS2" + np.array([len(doc_ids), 0, 0, 0], "<u4").tobytes() + front
    kinds, counts, rank = _ranks(flat)
    before = np.concatenate([[len(kinds)], rank[:-1]])
    before[::block] = len(kinds)
    raw = _Head.of(rank, before, kinds, counts)
    head = _Head(raw)
    key = before * (len(kinds) + 1) + rank
    pair = np.minimum(np.searchsorted(head.key, key), max(len(head.key) - 1, 0))
    pair = np.where(head.key[pair] == key, pair, -1) if len(head.key) else np.full(len(key), -1)
    steps = min(block, len(flat))

    def across(x: np.ndarray, kind: type) -> np.ndarray:
        padded = np.zeros(lanes * steps, kind)
        padded[: len(x)] = x
        return np.ascontiguousarray(padded.reshape(lanes, steps).T)

    sizes = np.full(lanes, block, np.int64)
    sizes[-1] = len(flat) - (lanes - 1) * block
    words, used = _encode_lanes(across(rank, np.uint32), across(pair, np.int32), int(sizes[-1]), head)
    checks = [zlib.crc32(flat[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(lanes)]
    body = [w[:n].astype("<u4").tobytes() for w, n in zip(words, used.tolist(), strict=True)]
    table = np.stack([sizes, used, np.array(checks, np.int64)], 1).astype("<u4").tobytes()
    return b"TKS2" + np.array([len(doc_ids), lanes, len(raw), zlib.crc32(raw)], "<u4").tobytes() + front + table + raw + b"".join(body)


def decode_segment(raw: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents' ids and tokens.  A head or block whose checksum is wrong raises ValueError."""
    if raw[:4] != b"TKS2":
        raise ValueError("not a segment")
    docs, blocks, size, check = np.frombuffer(raw, "<u4", 4, 4).tolist()
    at = 20
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    lengths = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
    at += 12 * docs
    if not blocks:
        return doc_ids, [np.zeros(0, np.uint32)] * docs
    table = np.frombuffer(raw, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * blocks
    if zlib.crc32(raw[at : at + size]) != check:
        raise ValueError("the head is damaged")
    head = _Head(raw[at : at + size])
    data = np.frombuffer(raw, "<u4", int(table[:, 1].sum()), at + size)
    words = np.zeros((blocks, int(table[:, 1].max())), np.uint32)
    ends = np.cumsum(table[:, 1])
    for i in range(blocks):
        words[i, : table[i, 1]] = data[ends[i] - table[i, 1] : ends[i]]
    rank = _decode_lanes(words, int(table[0, 0]), int(table[-1, 0]), head)
    # a damaged block may give a rank that isn't there; its checksum tells
    ids = head.ids.astype(np.uint32)[np.minimum(rank.T, head.kinds - 1)]
    parts = [ids[i, : table[i, 0]] for i in range(blocks)]
    for part, own in zip(parts, table[:, 2].tolist(), strict=True):
        if zlib.crc32(part.astype("<u4").tobytes()) != own:
            raise ValueError("a block is damaged")
    return doc_ids, np.split(np.concatenate(parts), np.cumsum(lengths)[:-1])


class Tokens:
    """A tokenizer of the tokenizers library, asked once for each stretch between spaces.

    Its pre-tokenizer never joins what stands before a space or around a line end with what follows, so a text whose white
    space is single spaces and line ends, none of them first or last, is encoded stretch by stretch; any other text goes to
    the library as a whole.  Ids of stretches are kept in two generations: what isn't asked for while KEPT others come goes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        #: Octets of each id: a byte-level token has a character for each.
        self.octets = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.octets[i] = len(token)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [_marked(t) for t in texts]
        sizes = [0 if m is None else m.count("\0") + 1 for m in marked]
        ids = self._plain([m for m in marked if m is not None], sizes)
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if t else [], np.uint32) if m is None else i for m, i, t in zip(marked, ids, texts, strict=True)]

    def _plain(self, marked: list[str], sizes: list[int]) -> list[np.ndarray]:
        """The ids of each text of that many stretches; texts of none have no ids."""
        if not marked:
            return [np.zeros(0, np.uint32)] * len(sizes)
        whole = pa.array(["\0".join(marked)], pa.large_string())
        stretches = pc.split_pattern(whole, "\0").flatten().dictionary_encode()
        words = stretches.dictionary.to_pylist()
        if len(self.kept) > KEPT:
            self.kept, self.old = {}, self.kept
        kept, old = self.kept, self.old
        new = []
        for w in words:
            if w not in kept:
                if w in old:
                    kept[w] = old[w]
                else:
                    new.append(w)
        self._ask(new)
        found = [kept[w] for w in words]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)])
        lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.uint32)))
        lists = lists.take(stretches.indices)
        starts = lists.offsets.to_numpy()
        flat, at = lists.values.to_numpy(), starts[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _ask(self, new: list[str]) -> None:
        """Keeps the ids of stretches.  Those that begin with a space go to the library side by side, TOGETHER at a time; its
        ids are cut where the octets of each end, and where none ends there the library is asked for each alone."""
        alone = [w for w in new if w[0:1] != " "]
        spaced = [w for w in new if w[0:1] == " "]
        for i in range(0, len(spaced), 200 * TOGETHER):
            groups = [spaced[k : k + TOGETHER] for k in range(i, min(i + 200 * TOGETHER, len(spaced)), TOGETHER)]
            for group, e in zip(groups, self.batch(["".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.cumsum(self.octets[ids])
                own = np.cumsum([len(w.encode()) for w in group])
                at = np.searchsorted(ends, own)
                if not len(ends) or ends[-1] != own[-1] or (ends[at] != own).any():
                    alone += group
                    continue
                raw, cut = ids.tobytes(), (4 * at + 4).tolist()
                self.kept.update(zip(group, map(raw.__getitem__, map(slice, [0, *cut[:-1]], cut)), strict=True))
        for i in range(0, len(alone), 20_000):
            for w, e in zip(alone[i : i + 20_000], self.batch(alone[i : i + 20_000], add_special_tokens=False), strict=True):
                self.kept[w] = array("I", e.ids).tobytes()


#: White space but the space and the line end; all of it is unprintable.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def _marked(text: str) -> str | None:
    """The text with a zero before each space and around each line end; None if it is empty or its white space isn't as plain
    as that."""
    lines = text.count("\n")
    if not text or "\0" in text or len(text.split()) != text.count(" ") + lines + 1:
        return None
    # a line end beside a no-break space is one stretch of white space to the library, and the count above can't tell
    if not (text.replace("\n", " ") if lines else text).isprintable() and _OTHER_SPACE.search(text):
        return None
    if lines:
        text = text.replace("\n", "\0\n\0")
    return text.replace(" ", "\0 ")


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _at_once(texts: pa.Array) -> list[int]:
    """How many rows at a time have AT_ONCE octets together, about."""
    group = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    return np.unique(group, return_counts=True)[1].tolist()


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes the ids of all texts, each with end_id after it, as a table of segments in ascending order of doc_id.

    Null texts are empty.  Rows without an id come first, as id -2**63.  Rows with equal ids follow one another, by their
    texts' hashes.  A task holds one segment and one batch of texts, not its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = _tokens(tokenizer_path), 0
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        part, held = 0, 0

        def flush() -> pa.RecordBatch:
            raw = encode_segment(ids, tokens)
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([held]), pa.array([raw], pa.binary())], ["part", "segment", "n_tokens", "raw"])
            ids.clear()
            tokens.clear()
            return row

        for batch in batches:
            at = 0
            for n in _at_once(batch.column(1)):
                rows, at = batch.slice(at, n), at + n
                part = rows.column(2)[0].as_py()
                for i, t in zip(rows.column(0).to_pylist(), coder.encode([x or "" for x in rows.column(1).to_pylist()]), strict=True):
                    ids.append(i)
                    tokens.append(np.append(t, np.uint32(end_id)))
                    held += len(t) + 1
                    if held >= SEGMENT:
                        yield flush()
                        number, held = number + 1, 0
        if ids:
            yield flush()
        release()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, "part long, segment long, n_tokens long, raw binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of each document in the segments under path."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per written part
    parts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("in")).join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("segment").alias("s"), (F.col("base") + F.col("in")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, tokens = decode_segment(batch.column(2)[k].as_py())
                n = len(tokens)
                sizes = np.array([len(t) for t in tokens], np.int64)
                checks = pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64())
                own = [pa.array(np.full(n, batch.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                arrays = [*own, pa.array(doc_ids, mask=doc_ids == -(1 << 63)), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), checks]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array([t.astype(np.int64) for t in tokens], pa.list_(pa.int64()))] * with_ids, ["part", "segment", "doc_id", "offset", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    out = rows.select("part", "segment", "raw").mapInArrow(run, "part long, segment long, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = out.join(starts, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))  # rows of documents, not segments
    return out.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

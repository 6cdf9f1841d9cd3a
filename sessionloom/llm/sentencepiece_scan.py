"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a BPE model's encoding are a path: a sequence of pieces is the encoding exactly if each piece encodes as
itself and each two neighbours, joined, encode as those two.  Edges have weight 0 if that holds, minus infinity if not, and
the best path is the only one; so is the best path to each place of a word.

Every text is cut into chunks of CHUNK characters, wherever that falls.  The states at a cut are the pieces that start before
it, with how far they reach over it; at the start of a word, which no piece reaches over, there is one state.  A chunk's
transfer matrix from the states at its start to those at its end is found without knowing the start.  Matrices combine
associatively; forward and backward over the chunks they leave one state at each cut, and then each chunk traces its own
pieces back by itself.  Between the first and the last start of a word in a chunk the matrix is a column, so what lies there
is traced from the words' starts: all new words of a batch in one recurrence over their places, in numpy.

The chunks of a document longer than SPREAD characters are rows of a table, dealt out to tasks: matrices are computed apart,
combined by groups of GROUP chunks, then document by document, and each chunk is traced back where it lies.  Other documents
take the same steps within their task.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release

SPACE = "▁"
#: Characters of a chunk; characters of a document whose chunks are dealt out; chunks of a group; words that a task keeps; rows
#: that it takes at once; characters of new words that go through the recurrence at once.
CHUNK, SPREAD, GROUP, KEPT, ROWS, HELD = 8192, 1 << 16, 256, 1 << 17, 128, 1 << 20
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_START = re.compile(f"(?<!{SPACE}){SPACE}")
#: A state is a piece and how far it reaches over the cut; this one is the start of a word, or the end of the text.
State = tuple[str, int]
EDGE: State = ("", 0)
Matrix = dict[State, frozenset[State]]
Chunk = tuple[str, str, str]


class _Table:
    """Whole numbers to whole numbers: open addressing in numpy."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - len(self.keys).bit_length() + 1)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't in the table."""
        self.used += len(keys)
        while 2 * self.used > len(self.keys):
            old, own = self.keys >= 0, (self.keys, self.values)
            self.keys, self.values = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.keys), np.int64)
            self._put(own[0][old], own[1][old])
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several keys for one place the last stays
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Encoder:
    """A model's pieces, with the weights of their pairs kept.

    Symbols are the model's ids; a character that is no piece is the number of pieces plus its code point."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = self.model.get_piece_size()
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.octet = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.high = {self.octet[b]: b for b in range(128, 256)}
        self.is_high = np.zeros(n, bool)
        self.is_high[list(self.high)] = True
        self.shown = list(self.pieces)  # an octet below 128 is a character
        for b in range(128):
            self.shown[self.octet[b]] = chr(b)
        usable = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i))]
        self.scores = [self.model.get_score(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.strip(SPACE) or (p.endswith(SPACE) and p.strip(SPACE)) for p in self.ids):
            raise ValueError("a piece of this model reaches over the start of a word")
        self.words = _Words(self)
        self.pairs = _Table()
        self.joined: dict[tuple[str, str], bool] = {}
        self.alone = np.full(n, -1, np.int8)  # whether a piece encodes as itself; -1: not known yet
        nodes: dict[tuple[int, str], int] = {}
        ends: list[int] = [-1]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                at = nodes.setdefault((at, c), len(nodes) + 1)
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends)
        self.tree = _Table()
        self.tree.add(np.array([(a << 21) + ord(c) for a, c in nodes]), np.array(list(nodes.values())))

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair of neighbours again and again; unknown characters stay."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], i)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def symbol(self, piece: str) -> int:
        found = self.ids.get(piece)
        return self.size + ord(piece) if found is None else found

    def single(self, symbols: np.ndarray) -> np.ndarray:
        """Whether pieces encode as themselves."""
        for i in np.unique(symbols[self.alone[symbols] < 0]).tolist():
            self.alone[i] = self.merge(self.pieces[i]) == [self.pieces[i]]
        return self.alone[symbols] == 1

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weight 0 (true) or minus infinity of the symbol b after a; a is -1 at the start of a word."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero((a >= 0) & (a < self.size) & (b < self.size))  # an unknown character never merges
        keys = a[both] * self.size + b[both]
        found = self.pairs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.used > 1 << 21:
                self.pairs = _Table()
                new = np.unique(keys)
            p = self.pieces
            self.pairs.add(new, np.array([self.merge(p[k // self.size] + p[k % self.size]) == [p[k // self.size], p[k % self.size]] for k in new.tolist()], np.int64))
            found = self.pairs.get(keys)
        out[both] = found == 1
        return out

    def joins(self, a: str, b: str) -> bool:
        """As join(), for two pieces; with a empty, whether b encodes as itself."""
        found = self.joined.get((a, b))
        if found is None:
            if len(self.joined) > KEPT:
                self.joined.clear()
            found = self.joined[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def starting(self, text: str, at: int) -> Iterator[str]:
        """Pieces, and single characters, that the text has at a place."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            piece = text[at : at + n]
            if n == 1 or (piece in self.ids and self.joins("", piece)):
                yield piece

    def whole_words(self, words: list[str]) -> list[bytes]:
        """The ids of whole words: one recurrence over the words' places, for all words at once.

        Of the pieces that end at a place the one is kept that joins the piece kept where it starts."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        own = np.repeat(ends - lengths, lengths)
        end = np.repeat(ends, lengths)
        live, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, stops, symbols = [], [], []
        for n in range(1, self.longest + 1):
            inside = live + n <= end[live]
            live, node = live[inside], node[inside]
            if n == 1:
                every, node = live, self.tree.get((node << 21) + chars[live])
                piece = np.where(node >= 0, self.ends[node], -1)
                starts.append(every)
                stops.append(every + 1)
                symbols.append(np.where(piece >= 0, piece, self.size + chars))
                live, node = live[node >= 0], node[node >= 0]
                continue
            node = self.tree.get((node << 21) + chars[live + n - 1])
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            piece = self.ends[node]
            some = np.flatnonzero(piece >= 0)
            some = some[self.single(piece[some])]
            starts.append(live[some])
            stops.append(live[some] + n)
            symbols.append(piece[some])
        start, stop, symbol = np.concatenate(starts), np.concatenate(stops), np.concatenate(symbols)
        level = stop - own[start]
        order = np.argsort(level, kind="stable")
        start, stop, symbol, level = start[order], stop[order], symbol[order], level[order]
        cuts = np.searchsorted(level, np.arange(1, int(lengths.max(initial=0)) + 2))
        last, back = np.full(len(chars) + 1, -2, np.int64), np.zeros(len(chars) + 1, np.int64)
        first = start == own[start]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            before = np.where(first[a:b], -1, last[start[a:b]])
            able = np.flatnonzero(before > -2)
            able = able[self.join(before[able], symbol[a:b][able])]
            last[stop[a:b][able]] = symbol[a:b][able]
            back[stop[a:b][able]] = start[a:b][able]
        at, who, pieces, owners = ends.copy(), np.arange(len(words)), [], []
        begin = ends - lengths
        while len(who):
            pieces.append(last[at])
            owners.append(who)
            at = back[at]
            more = at > begin[who]
            at, who = at[more], who[more]
        if not pieces:
            return [b""] * len(words)
        pieces, owners = np.concatenate(pieces[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owners, kind="stable")
        flat, counts = pieces[order], np.bincount(owners, minlength=len(words))
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum(counts) * 4
        out = [raw[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
        for k in np.unique(owners[order][flat >= self.size]).tolist():
            out[k] = self.spell(np.frombuffer(out[k], "<u4").tolist())
        return out

    def spell(self, symbols: list[int]) -> bytes:
        """Ids of symbols; a character that is no piece is its UTF-8 octets."""
        ids: list[int] = []
        for i in symbols:
            if i < self.size:
                ids.append(i)
            else:
                ids += [self.octet[b] for b in chr(i - self.size).encode("utf-8")]
        return np.array(ids, "<u4").tobytes()

    def reach(self, chunk: Chunk, a: int, b: int) -> tuple[dict[int, dict[str, list]], dict[State, int]]:
        """For the part [a, b) of a chunk's body: nodes, and the states at its start.

        nodes: end of piece -> piece -> [bit mask of the starting states from which a path reaches it, pieces before it]."""
        left, body, right = chunk
        text = left + body + right
        start, end = len(left) + a, len(left) + b
        nodes: dict[int, dict[str, list]] = {}
        entries: dict[State, int] = {}
        if a or self.starts_word(chunk):
            entries[EDGE] = 0
            nodes[start] = {"": [1, []]}
        else:
            for begin in range(max(0, start - self.longest), start):
                for piece in self.starting(text, begin):
                    if begin + len(piece) >= start:
                        entries[piece, begin + len(piece) - start] = len(entries)
                        nodes.setdefault(begin + len(piece), {})[piece] = [1 << len(entries) - 1, []]
        for at in range(start, end):
            here = nodes.get(at)
            if not here:
                continue
            for piece in self.starting(text, at):
                mask, before = 0, []
                for last, (reached, _) in here.items():
                    if not last or self.joins(last, piece):
                        mask |= reached
                        before.append(last)
                if mask:
                    slot = nodes.setdefault(at + len(piece), {}).setdefault(piece, [0, []])
                    slot[0] |= mask
                    slot[1] += before
        return nodes, entries

    @staticmethod
    def starts_word(chunk: Chunk) -> bool:
        left, body, _ = chunk
        return not left or (body[0] == SPACE and left[-1] != SPACE)

    @staticmethod
    def ends_word(chunk: Chunk) -> bool:
        _, body, right = chunk
        return not right or (right[0] == SPACE and body[-1] != SPACE)

    def parts(self, chunk: Chunk) -> tuple[int, int]:
        """(h, t): body[:h] belongs to a word that starts before the chunk, body[t:] to one that ends after it."""
        left, body, _ = chunk
        if self.starts_word(chunk):
            h = 0
        else:
            found = _START.search(left[-1:] + body, 2 if body[0] == SPACE else 1)
            if found is None:
                return len(body), len(body)
            h = found.start() - 1
        if self.ends_word(chunk):
            return h, len(body)
        t = len(body[: body.rindex(SPACE)].rstrip(SPACE))
        return h, max(h, t)

    def matrix(self, chunk: Chunk) -> Matrix:
        """From each state at the chunk's start the states that a path reaches at its end."""
        h, t = self.parts(chunk)
        size = len(chunk[1])
        if h == size and not self.starts_word(chunk):
            nodes, entries = self.reach(chunk, 0, size)
            return self._exits(chunk, 0, nodes, entries)
        ends = frozenset([EDGE])
        if t < size:
            ends = self._exits(chunk, t, *self.reach(chunk, t, size))[EDGE]
        if not h:
            return {EDGE: ends}
        nodes, entries = self.reach(chunk, 0, h)
        passed = 0
        for mask, _ in nodes.get(len(chunk[0]) + h, {}).values():
            passed |= mask
        return {state: ends if passed >> k & 1 else frozenset() for state, k in entries.items()}

    def _exits(self, chunk: Chunk, a: int, nodes: dict[int, dict[str, list]], entries: dict[State, int]) -> Matrix:
        begin, cut = len(chunk[0]) + a, len(chunk[0]) + len(chunk[1])
        whole = self.ends_word(chunk)
        found: Matrix = {}
        for state, k in entries.items():
            out = set()
            for at in range(cut, cut + self.longest):
                for piece, (mask, _) in nodes.get(at, {}).items():
                    if at - len(piece) < cut and (at - len(piece) >= begin or (piece, at - begin) in entries) and mask >> k & 1:
                        out.add(EDGE if whole and at == cut else (piece, at - cut))
            found[state] = frozenset(out)
        return found

    def _path(self, chunk: Chunk, a: int, b: int, entry: State, leave: State) -> list[str]:
        """The pieces that start in the part [a, b) of the body, on the path from a state at a to one at b."""
        nodes, entries = self.reach(chunk, a, b)
        start, cut, k = len(chunk[0]) + a, len(chunk[0]) + b, entries[entry]
        if leave == EDGE:
            at = cut
            piece = next(p for p, (mask, _) in nodes[cut].items() if mask >> k & 1)
        else:
            piece, at = leave[0], cut + leave[1]
        out: list[str] = []
        while piece and at - len(piece) >= start:
            out.append(piece)
            before, at = nodes[at][piece][1], at - len(piece)
            piece = next(p for p in before if nodes[at][p][0] >> k & 1)
        return out[::-1]

    def words_of(self, chunk: Chunk) -> list[str]:
        """The keys of the chunk's whole words: a word less its space mark, or with all of them if it has several."""
        h, t = self.parts(chunk)
        body = chunk[1] if h == 0 and t == len(chunk[1]) else chunk[1][h:t]
        if not body:
            return []
        if SPACE + SPACE in body:
            return [w if w.startswith(SPACE + SPACE) else w[1:] for w in _WORDS.findall(body)]
        return body[1:].split(SPACE)

    def trace(self, chunk: Chunk, entry: State, leave: State, words: list[str]) -> bytes:
        """The ids of the pieces that start in the chunk.  words: its whole words, which are kept."""
        h, t = self.parts(chunk)
        size = len(chunk[1])
        spelled = lambda pieces: self.spell([self.symbol(p) for p in pieces])
        if h == size and not self.starts_word(chunk):
            return spelled(self._path(chunk, 0, size, entry, leave))
        raw = b"".join(map(self.words.__getitem__, words))
        if h:
            raw = spelled(self._path(chunk, 0, h, entry, EDGE)) + raw
        if t < size:
            raw += spelled(self._path(chunk, t, size, EDGE, leave))
        return raw

    def chunks(self, text: str, size: int = CHUNK) -> list[Chunk]:
        """The chunks of a text; each with the characters next to it that a piece may reach over."""
        if size < self.longest:
            raise ValueError("a chunk must be as long as the longest piece")
        line = SPACE + text.replace(" ", SPACE) if text else ""
        n = self.longest
        return [(line[max(0, a - n) : a], line[a : a + size], line[a + size : a + size + n]) for a in range(0, len(line), size)]

    def encode_all(self, texts: list[str], size: int = CHUNK) -> list[tuple[bytes, int]]:
        """The ids of texts as little-endian unsigned 32-bit integers, and how many chunks each had."""
        cut = [self.chunks(t, size) for t in texts]
        words = [[self.words_of(c) for c in own] for own in cut]
        self.words.learn(w for own in words for w in own)
        out = []
        for own, keys in zip(cut, words, strict=True):
            if len(own) == 1:
                through = [(EDGE, EDGE)]
            else:
                through = states([self.matrix(c) for c in own], EDGE, EDGE)
            out.append((b"".join(self.trace(c, a, b, w) for c, (a, b), w in zip(own, through, keys, strict=True)), len(own)))
        return out

    def encode(self, text: str, size: int = CHUNK) -> list[int]:
        return np.frombuffer(self.encode_all([text], size)[0][0], "<u4").tolist()

    def spelled(self, raw: bytes) -> str:
        """Pieces joined, with their space marks; octets joined to characters."""
        ids = np.frombuffer(raw, "<u4")
        if not self.is_high[ids].any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))
        out, octets = [], bytearray()
        for i in ids.tolist():
            if i in self.high:
                octets.append(self.high[i])
                continue
            if octets:
                out.append(octets.decode("utf-8", "replace"))
                octets.clear()
            out.append(self.shown[i])
        out.append(octets.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text again; the first space mark goes, the others are spaces."""
        return self.spelled(np.array(ids, "<u4").tobytes()).removeprefix(SPACE).replace(SPACE, " ")


class _Words(dict):
    """Words' ids, in two generations: what isn't asked for while KEPT others come goes."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.old[key]
        return found

    def learn(self, lists: Iterator[list[str]]) -> None:
        """Finds the ids of the words that aren't kept."""
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        every: set[str] = set()
        for words in lists:
            every.update(words)
        new = [w for w in every if w not in self and w not in self.old]
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and (held < HELD or end == at):
                held += len(new[end]) + 1
                end += 1
            own = new[at:end]
            self.update(zip(own, self.encoder.whole_words([w if w.startswith(SPACE) else SPACE + w for w in own]), strict=True))
            at = end


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices of weights 0 and minus infinity, as sets of states."""
    none: frozenset[State] = frozenset()
    return {s: none.union(*(b.get(t, none) for t in ends)) for s, ends in a.items()}


def product(matrices: list[Matrix]) -> Matrix:
    """The product, by halves: it is associative."""
    if len(matrices) == 1:
        return matrices[0]
    half = len(matrices) // 2
    return combine(product(matrices[:half]), product(matrices[half:]))


def states(matrices: list[Matrix], entry: State, leave: State) -> list[tuple[State, State]]:
    """The states at the start and the end of each chunk, on the only path from one state to another."""
    ahead = [frozenset([entry])]
    if not matrices:
        return []
    for m in matrices[:-1]:
        ahead.append(frozenset().union(*(m.get(s, frozenset()) for s in ahead[-1])))
    out, end = [], leave
    for m, able in zip(matrices[::-1], ahead[::-1], strict=True):
        start = next(s for s in able if end in m.get(s, ()))
        out.append((start, end))
        end = start
    return out[::-1]


def joined_crc(a: int, b: int, size: int) -> int:
    """The CRC-32 of two stretches of octets from the CRC-32 of each and the size of the second."""

    def times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit; the reversed polynomial of CRC-32
    bits = 8 * size
    while bits:
        if bits & 1:
            a = times(step, a)
        step = [times(step, x) for x in step]
        bits >>= 1
    return a ^ b


@lru_cache(maxsize=1)
def _encoder(model_path: str) -> Encoder:
    """One for each Python worker, whatever number of tasks it runs."""
    return Encoder(model_path)


def _lists(raws: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raws), np.int32)))


def _spread(docs: DataFrame, model_path: str, names: list[str], schema: T.StructType) -> DataFrame:
    """encode() of documents whose chunks are dealt out to tasks: docs has doc_id and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model_path)
        for batch in batches:
            for row in range(batch.num_rows):
                own = coder.chunks(batch.column(2)[row].as_py())
                for at in range(0, len(own), ROWS):
                    part = own[at : at + ROWS]
                    who = pa.array(np.full(len(part), row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(np.arange(at, at + len(part))), *(pa.array([c[k] for c in part], pa.string()) for k in range(3))], ["key", "doc_id", "k", "left", "body", "right"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model_path)
        for batch in batches:
            found = [pickle.dumps(coder.matrix(tuple(c))) for c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["key", "k", "matrix"])

    def grouped(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        whole = product([pickle.loads(m.as_py()) for m in rows["matrix"]])
        return pa.table({"key": rows["key"][:1], "g": rows["g"][:1], "matrix": pa.array([pickle.dumps(whole)], pa.binary())})

    def through(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("g")
        found = states([pickle.loads(m.as_py()) for m in rows["matrix"]], EDGE, EDGE)
        return pa.table({"key": rows["key"], "g": rows["g"], "ends": pa.array([pickle.dumps(x) for x in found], pa.binary())})

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        found = states([pickle.loads(m.as_py()) for m in rows["matrix"]], *pickle.loads(rows["ends"][0].as_py()))
        return pa.table({"key": rows["key"], "k": rows["k"], "ends": pa.array([pickle.dumps(x) for x in found], pa.binary())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = list(zip(*(part.column(c).to_pylist() for c in ("left", "body", "right")), strict=True))
                words = [coder.words_of(c) for c in own]
                coder.words.learn(words)
                raws, same = [], []
                for c, w, e in zip(own, words, part.column("ends"), strict=True):
                    start, end = pickle.loads(e.as_py())
                    raws.append(coder.trace(c, start, end, w))
                    same.append(coder.spelled(raws[-1]) == c[1][start[1] :] + c[2][: end[1]])
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), part.column("k"), pa.array(raws, pa.binary()), pa.array(same)], ["key", "doc_id", "k", "raw", "same"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        raws = [r.as_py() for r in rows["raw"]]
        crc = 0
        for r in raws:
            crc = joined_crc(crc, zlib.crc32(r), len(r))
        out = {"doc_id": rows["doc_id"][:1], "n_tokens": pa.array([sum(map(len, raws)) // 4]), "ids_crc32": pa.array([crc]), "n_chunks": pa.array([len(raws)]), "decoded": pa.array([all(rows["same"].to_pylist())])}
        if "ids" in names:
            out["ids"] = _lists([b"".join(raws)])
        return pa.table(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(cut, f"key long, doc_id {kind}, k long, left string, body string, right string")
    rows, _ = materialize(rows.repartition("key", "k"), "chunks")
    found, _ = materialize(rows.select("key", "k", "left", "body", "right").mapInArrow(matrices, "key long, k long, matrix binary").withColumn("g", F.floor(F.col("k") / GROUP)), "matrices")
    groups = found.groupBy("key", "g").applyInArrow(grouped, "key long, g long, matrix binary")
    ends = groups.groupBy("key").applyInArrow(through, "key long, g long, ends binary")
    ends = found.join(ends, ["key", "g"]).groupBy("key", "g").applyInArrow(within, "key long, k long, ends binary")
    traced = rows.join(ends, ["key", "k"]).mapInArrow(trace, f"key long, doc_id {kind}, k long, raw binary, same boolean")
    return traced.groupBy("key").applyInArrow(whole, schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of ids as little-endian unsigned 32-bit integers), n_chunks, decoded (whether decoding the
    ids gives the text again; a space mark of the text decodes as a space) and, if asked, ids.

    Null and empty texts have no ids and no chunks.  Repeated rows are encoded one by one, alike.  An empty table gives no
    rows.  Other columns are not read.  model_path: a file that all executors have; it isn't copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = coder.encode_all(texts)
                raws = [raw for raw, _ in found]
                rows = [(len(raw) // 4, zlib.crc32(raw), n) for raw, n in found]
                same = [coder.spelled(raw) == (SPACE + t.replace(" ", SPACE) if t else "") for raw, t in zip(raws, texts, strict=True)]
                arrays = [part.column(0), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], pa.array(same)]
                yield pa.RecordBatch.from_arrays(arrays + [_lists(raws)] * with_ids, names)
        release()

    names = ["doc_id", "n_tokens", "ids_crc32", "n_chunks", "decoded"] + ["ids"] * with_ids
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("decoded", T.BooleanType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > SPREAD
    return rows.where(~long).mapInArrow(run, schema).unionByName(_spread(rows.where(long), model_path, names, schema))

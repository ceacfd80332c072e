"""Operator 5, sampled piece segmentations by forward filtering and backward sampling.

A text is cut where no piece of the vocabulary spans two neighbouring characters; there its lattice
factorises, so units are sampled independently and the text's distribution stays exact, however long
a unit is. Forward filtering over a unit's lattice gives, for each position, the log weight of all
ways to reach it; it runs once for each distinct unit that a task meets (a bounded store keeps the
lattices). Backward sampling walks all occurrences of a group of texts at once, and draws each edge
with a counter-based generator keyed by the row's key, the unit's number and the step, so that a row's
segmentation does not depend on how rows are dealt. Characters that no piece covers, and a literal
word mark, are byte pieces: decoding gives back the exact text.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A store of more edges than this starts anew; lattices are rebuilt then, with the same draws.
STORE_EDGES = 1_200_000
#: Edges that a store has room for; a group of texts that needs more makes more.
ROOM = STORE_EDGES * 5 // 4


class Pieces:
    """Pieces, ids and weights of a public model, and a trie of the pieces as a hash table.

    The log weight of a piece falls with its rank; ``sharpness`` scales it: the larger, the closer
    sampling is to the best path. A byte piece weighs far less than any other.
    """

    def __init__(self, model: bytes, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        texts, rank = {}, 0
        self.weight = np.zeros(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                rank += 1
                texts[piece.replace(MARK, " ")] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                self.weight[i] = -sharpness * math.log(rank + 16)
        self.byte_weight = -sharpness * math.log(rank + 1e6)
        self.longest = max(map(len, texts), default=1)
        self._build(texts)

    def _build(self, texts: dict[str, int]) -> None:
        # Letters of pieces of several characters come first: only they can be spanned.
        inner = dict.fromkeys("".join(t for t in texts if len(t) > 1))
        letters = {c: k for k, c in enumerate(inner | dict.fromkeys("".join(texts)), 1)}
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        for c, k in letters.items():
            self.letter[ord(c)] = k
        self.inner = len(inner) + 1
        self.spans = np.zeros(self.inner**2, bool)
        self.spans[[letters[a] * self.inner + letters[b] for t in texts for a, b in zip(t, t[1:])]] = True
        self.radix = len(letters) + 1
        moves, ends = {}, [-1]
        for text, i in texts.items():
            at = 0
            for c in text:
                key = at * self.radix + letters[c]
                if key not in moves:
                    moves[key] = len(ends)
                    ends.append(-1)
                at = moves[key]
            ends[at] = i
        self.end = np.array(ends, np.int32)
        keys = np.fromiter(moves, np.int64, len(moves))
        values = np.fromiter(moves.values(), np.int32, len(moves))
        self.bits = max(8, int(len(moves) * 4).bit_length())
        self.table_key, self.table_to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.table_key[slot[todo]] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(slot[todo], return_index=True)[1]] = True
            put = free & first
            self.table_key[slot[todo[put]]], self.table_to[slot[todo[put]]] = keys[todo[put]], values[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The trie's next nodes, -1 where there is none."""
        keys = node.astype(np.int64) * self.radix + letter
        slot = self._slot(keys)
        found = self.table_key[slot]
        out = np.where(found == keys, self.table_to[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):  # collisions, which are few
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.table_key[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.table_to[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all texts in order, and how many each text has."""
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(len(texts), np.int64)
        letters = self.letter[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        letters[letters >= self.inner] = 0
        cut = np.ones(len(letters) + 1, bool)
        np.logical_not(self.spans[letters[:-1] * self.inner + letters[1:]], out=cut[1:-1])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cut[ends] = True
        at = np.flatnonzero(cut)
        places = at.tolist()
        return [whole[a:b] for a, b in zip(places, places[1:])], np.diff(np.searchsorted(at, ends), prepend=0)

    def decode(self, ids) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit counters (SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lattices(pieces: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last, key, emit, to) of the lattices of units, with their forward weights.

    A state is a position of a unit; ``last`` has each unit's final one. Edges are in the order of the
    state that they end in; ``key`` is that state and, in 32 bits, the cumulative probability of its
    edges, so that one sorted search draws the last edge of a path to a state. ``emit`` is the edge's
    piece (or -1 - code point), ``to`` the state before it (-1: the unit's start).
    """
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, units), np.int32, len(units))
    begin = np.cumsum(sizes, dtype=np.int32) - sizes
    place = np.arange(len(codes), dtype=np.int32) - np.repeat(begin, sizes)  # of a character in its unit
    left = np.repeat(sizes, sizes) - place
    letters = pieces.letter[codes]
    state = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(units), dtype=np.int32), sizes)
    at, node, found = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32), []
    for length in range(1, pieces.longest + 1):
        node = pieces.step(node, letters[at + (length - 1)])
        live = node >= 0
        at, node = at[live], node[live]
        piece = pieces.end[node]
        hit = piece >= 0
        found.append((at[hit], np.full(hit.sum(), length, np.int32), piece[hit]))
        on = left[at] > length
        at, node = at[on], node[on]
        if not len(at):
            break
    start, length, piece = (np.concatenate(x) for x in zip(*found))
    covered = np.zeros(len(codes), bool)
    covered[start + length - 1] = True
    bare = np.flatnonzero(~covered).astype(np.int32)  # no piece ends with this character
    spelled = 1 + (codes[bare] > 0x7F).astype(np.int64) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
    weight = np.concatenate([pieces.weight[piece], spelled * pieces.byte_weight])
    emit = np.concatenate([piece, -1 - codes[bare].astype(np.int32)])
    start, length = np.concatenate([start, bare]), np.concatenate([length, np.ones(len(bare), np.int32)])
    depth, source = place[start] + length, state[start]
    into = source + length
    # Longest pieces first in a state: found by length, so a stable sort by state keeps lengths in order.
    order = np.argsort(into, kind="stable")
    by_depth = np.argsort(depth[order], kind="stable")
    emit, source, into, weight, depth = emit[order], source[order], into[order], weight[order], depth[order]
    d_source, d_into, d_weight, depth = source[by_depth], into[by_depth], weight[by_depth], depth[by_depth]
    alpha = np.zeros(len(codes) + len(units))
    heads = np.flatnonzero(np.concatenate([[True], d_into[1:] != d_into[:-1]]))
    cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    head_cuts = np.searchsorted(heads, cuts)
    counts = np.diff(np.append(heads, len(depth)))
    for a, b, c, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), head_cuts[:-1].tolist(), head_cuts[1:].tolist()):  # forward, all units at once
        w = alpha[d_source[a:b]] + d_weight[a:b]
        top = np.maximum.reduceat(w, heads[c:d] - a)
        total = np.add.reduceat(np.exp(w - np.repeat(top, counts[c:d])), heads[c:d] - a)
        alpha[d_into[heads[c:d]]] = top + np.log(total)
    share = np.exp(alpha[source] + weight - alpha[into])
    heads = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
    counts = np.diff(np.append(heads, len(into)))
    more, k = heads[counts > 1], 1
    while len(more):  # running sums in each state, alike whatever else is in the group
        share[more + k] += share[more + k - 1]
        k += 1
        more = more[into[np.minimum(more + k, len(into) - 1)] == into[more]]
        more = more[more + k < len(into)]
    bound = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.int64)
    bound[heads + counts - 1] = 2**32 - 1
    last = begin + sizes + np.arange(len(units), dtype=np.int32)
    opens = np.zeros(len(alpha), bool)
    opens[begin + np.arange(len(units), dtype=np.int32)] = True
    return last, (into.astype(np.int64) << 32) + bound, emit, np.where(opens[source], np.int32(-1), source)


class Store:
    """The lattices of the units that a task has met, up to STORE_EDGES."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.key = pieces, np.zeros(0, np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.states = self.edges = 0
        self.last = np.zeros(0, np.int64)
        if len(self.key) != ROOM:  # pages that are never written take no memory
            self.key, self.emit, self.to = np.empty(ROOM, np.int64), np.empty(ROOM, np.int32), np.empty(ROOM, np.int32)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The number of each unit in the store, after those that are new were added."""
        if self.edges > STORE_EDGES:
            self.clear()
        known, had = self.known, len(self.known)
        out = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        if len(known) > had:
            new = list(islice(known, had, None))
            last, key, emit, to = lattices(self.pieces, new)
            states = int(last[-1]) + 1
            self.last = np.concatenate([self.last, last + np.int64(self.states)])
            key += self.states << 32
            to[to >= 0] += self.states
            grown = self.edges + len(key)
            if grown > len(self.key):  # one group with very many new units
                self.key, self.emit, self.to = (np.concatenate([old[: self.edges], np.empty(len(key), old.dtype)]) for old in (self.key, self.emit, self.to))
            for mine, added in ((self.key, key), (self.emit, emit), (self.to, to)):
                mine[self.edges : grown] = added
            self.states, self.edges = self.states + states, grown
        return out


def segment(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts, one after the other, and where each text's begin and end."""
    store = store or Store(pieces)
    units, sizes = pieces.units(texts)
    if not units:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
    occ = store.numbers(units)
    row = np.repeat(np.arange(len(texts)), sizes)
    number = np.arange(len(occ)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    stream = mix64(mix64(keys.astype(np.uint64) ^ np.uint64(seed))[row] + number.astype(np.uint64))
    at = np.argsort(occ, kind="stable")  # occurrences of a unit together: their searches are near each other
    edges, stream = store.key[: store.edges], stream[at]
    state, step, drawn = store.last[occ[at]], 0, []
    while len(at):  # backward, all occurrences at once
        u = (mix64(stream + np.uint64(step)) >> np.uint64(32)).view(np.int64)
        edge = np.searchsorted(edges, (state << 32) + u)
        drawn.append((at, store.emit[edge]))
        state = store.to[edge].astype(np.int64)
        on = state >= 0
        at, state, stream, step = at[on], state[on], stream[on], step + 1
    pieces_of = np.zeros(len(occ), np.int64)
    for a, _ in drawn:
        pieces_of[a] += 1
    end = np.cumsum(pieces_of)
    ids = np.zeros(int(end[-1]), np.int64)
    for k, (a, e) in enumerate(drawn):
        ids[end[a] - 1 - k] = e
    where = np.repeat(row, pieces_of)
    bytewise = np.flatnonzero(ids < 0)
    if len(bytewise):
        spelled = [[pieces.byte_id[b] for b in chr(-1 - v).encode()] for v in ids[bytewise].tolist()]
        width = np.ones(len(ids), np.int64)
        width[bytewise] = [len(s) for s in spelled]
        begin = np.cumsum(width) - width
        out = np.repeat(ids, width)
        for b, s in zip(begin[bytewise].tolist(), spelled):
            out[b : b + len(s)] = s
        ids, where = out, np.repeat(where, width)
    return ids.astype(np.int32), np.searchsorted(where, np.arange(len(texts) + 1)).astype(np.int32)


def row_key(value) -> int:
    """64 bits of an id; a null id has a key too."""
    return int.from_bytes(hashlib.blake2b(repr(value).encode(), digest_size=8).digest(), "little")


def read_model(spark, path: str) -> bytes:
    """A model file's bytes, read on the driver, as executors need not have it."""
    with open(path, "rb") as f:
        return f.read()


#: Texts of about so many characters are sampled together.
GROUP = 150_000


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, seed: int = 20, sharpness: float = 1.0, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_pieces, round_trip, and ids or (``digest``) ids_sha256.

    ids are the pieces of a sampled segmentation of the whole text, ids_sha256 the lowercase hex
    digest of them as little-endian 32-bit integers; round_trip tells that decoding gave the text back.
    Null is an empty text, which has no pieces. Equal ids and texts have equal segmentations, so
    repeated rows agree; null ids share one key. An empty table gives no rows.
    """
    proto = read_model(docs.sparkSession, model)

    def run(batches):
        pieces = Pieces(proto, sharpness)
        store = Store(pieces)
        for batch in batches:
            names, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(sizes):
                end, size = begin + 1, sizes[begin]
                while end < len(sizes) and size + sizes[end] <= GROUP:
                    size += sizes[end]
                    end += 1
                texts = [t or "" for t in column.slice(begin, end - begin).to_pylist()]
                ids, cuts = segment(pieces, texts, np.array([row_key(x) for x in names.slice(begin, end - begin).to_pylist()], np.uint64), seed, store)
                spans = list(zip(texts, cuts[:-1].tolist(), cuts[1:].tolist()))
                same = [pieces.decode(ids[a:b].tolist()) == t.encode() for t, a, b in spans]
                if digest:
                    last = pa.array([hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest() for _, a, b in spans])
                else:
                    last = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))
                yield pa.RecordBatch.from_arrays([names.slice(begin, end - begin), pa.array(np.diff(cuts).astype(np.int64)), pa.array(same), last], names=[id_col, "n_pieces", "round_trip", "ids_sha256" if digest else "ids"])
                begin = end

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_pieces long, round_trip boolean, " + ("ids_sha256 string" if digest else "ids array<int>"))


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` with ``text``: the exact text of the pieces in ``ids_col``.

    Null ids give a null text, an empty list an empty one; repeated rows stay, other columns of any
    name stay (a column ``text`` is replaced), and an empty table gives no rows.
    """
    proto = read_model(encoded.sparkSession, model)

    @F.pandas_udf("string", F.PandasUDFType.SCALAR_ITER)
    def text(columns):
        pieces = Pieces(proto)
        for column in columns:
            yield column.map(lambda ids: None if ids is None else pieces.decode(ids).decode())

    return encoded.withColumn("text", text(ids_col))

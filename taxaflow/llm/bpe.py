"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A byte-pair encoding is the only way to cut a text into tokens such that every
token and every pair of neighbours encodes to itself.  So the encoder is a
nondeterministic transducer: a hypothesis is the last finished token and a place
in the trie of tokens.  Its determinised states, sets of hypotheses with the
tokens they still owe, are made when first reached; a token is emitted as soon as
all hypotheses agree on it, which takes no more bytes than the longest token has.

Null text is empty and gives no ids.  Null or empty id lists decode to an empty
text.  Rows are independent, so ties, repeated rows, empty tables and further
columns need no rule.
"""

from __future__ import annotations

import base64
import gc
from array import array
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.llm.common import Memo, Recent, claim, lists, ragged, remembers

#: Determinised states kept by a worker; beyond, they are made anew when reached.
STATES = 150_000
#: Pieces remembered by a worker.
PIECES = 300_000
#: A rank above all others.
NEVER = 1 << 30
#: New objects of a worker between two searches for cycles.
SELDOM = 200_000
#: Chain of a hypothesis without any token.
NOTHING = -1
#: Keys of a number and a byte: odd and over 255, so that they differ, and in their low bits too.
SPREAD = 257


class Transducer:
    """The merges of ``ranks`` (token bytes to rank) as a transducer from bytes to ranks."""

    def __init__(self, ranks: dict[bytes, int], most: int = STATES):
        self.ranks, self.most = ranks, most
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.below: dict[int, int] = {}  # place * SPREAD + byte to place
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            place = 0
            for byte in token:
                place = self.below.setdefault(place * SPREAD + byte, len(self.ends))
                if place == len(self.ends):
                    self.ends.append(-1)
            self.ends[place] = rank
        self.inner = bytearray(len(self.ends))
        for arc in self.below:
            self.inner[arc // SPREAD] = 1
        self.own = Memo(lambda rank: self.merged(self.tokens[rank]) == [rank], 1 << 20)
        self.edges = Memo(self._edges, 1 << 18)
        self.pairs = Memo(self._apart, 1 << 18)
        self.steps = Memo(self._step, 1 << 18)
        self.shapes: dict[tuple, int] = {}
        self.places: list[tuple] = []
        self.forget()

    def forget(self) -> None:
        """Drop all states; they are made anew when reached.  Shapes stay: the bytes of the longest open token tell them, so the trie bounds them."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.arcs: dict[int, int] = {}  # state * SPREAD + byte to the next state, or to the complement of a place in ``emitted``
        self.emitted: list[tuple[int, tuple]] = []
        self._state(self._shape((0,)), ((NOTHING,),))

    def _shape(self, places: tuple) -> int:
        number = self.shapes.setdefault(places, len(self.places))
        if number == len(self.places):
            self.places.append(places)
        return number

    def _step(self, key: int) -> tuple[tuple, tuple, int]:
        """What a byte does to all hypotheses of a shape: those that go on, those that end a token with its rank, and the next shape."""
        shape, byte = divmod(key, SPREAD)
        stay, ended, places = [], [], []
        for i, place in enumerate(self.places[shape]):
            below = self.below.get(place * SPREAD + byte)
            if below is None:
                continue
            if self.inner[below]:
                stay.append(i)
                places.append(below)
            if self.ends[below] >= 0:
                ended.append((i, self.ends[below]))
        return tuple(stay), tuple(ended), self._shape((*places, 0))

    def _edges(self, rank: int) -> tuple[list, list]:
        """The growing first part and last part of a token while it is merged, each with the rank at which it grows next."""
        parts = self._parts(self.tokens[rank], 2)
        if len(parts) == 1:
            return [(parts[0], NEVER)], [(parts[0], NEVER)]
        first, last = self.edges[self.ranks[parts[0]]][0], self.edges[self.ranks[parts[1]]][1]
        whole = (self.tokens[rank], NEVER)
        return [*first[:-1], (parts[0], rank), whole], [*last[:-1], (parts[1], rank), whole]

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether two neighbours never merge across their border: at no time is that merge the next one."""
        left, right = self.edges[pair[0]][1], self.edges[pair[1]][0]
        i = j = 0
        while True:
            (a, grows), (b, then) = left[i], right[j]
            across = self.ranks.get(a + b, NEVER)
            if across < grows and across <= then and across < NEVER:  # of equal ranks the leftmost merges first
                return False
            if grows == then == NEVER:
                return self.own[pair[0]] and self.own[pair[1]]
            if grows <= then:
                i += 1
            else:
                j += 1

    def merged(self, piece: bytes) -> list[int]:
        """Ranks of a short piece by repeated merging."""
        return [self.ranks[x] for x in self._parts(piece, 1)]

    def _parts(self, piece: bytes, least: int) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _state(self, shape: int, chains: tuple) -> int:
        """Number of a state: a place in the trie and a chain, the tokens it owes, for each hypothesis.

        A hypothesis that owes nothing has the chain of ``NOTHING`` less the last
        token, or of ``NOTHING`` alone at the start.  The last hypothesis is the one
        whose last token has just ended.
        """
        number = self.numbers.setdefault((shape, chains), len(self.states))
        if number == len(self.states):
            self.states.append((shape, chains))
        return number

    def _arc(self, state: int, byte: int) -> int:
        shape, chains = self.states[state]
        stay, ended, shape = self.steps[shape * SPREAD + byte]
        for i, rank in ended:
            last = chains[i][-1]
            if self.own[rank] if last == NOTHING else self.pairs[last if last >= 0 else NOTHING - 1 - last, rank]:
                break
        reached = [chains[j] for j in stay]
        reached.append((*chains[i], rank) if last >= 0 else (rank,))
        first = reached[-1][0]
        sure = len(commonprefix(reached)) if all([x[0] == first for x in reached]) else 0  # tokens that all chains begin with
        if not sure:
            arc = self._state(shape, tuple(reached))
        else:
            emitted, free = reached[0][:sure], (NOTHING - 1 - reached[0][sure - 1],)
            arc = ~len(self.emitted)
            self.emitted.append((self._state(shape, tuple([x[sure:] or free for x in reached])), emitted))
        self.arcs[state * SPREAD + byte] = arc
        return arc

    def run(self, piece: bytes) -> list[int]:
        """Ranks of a piece of any length, byte by byte."""
        if len(self.states) > self.most:
            self.forget()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            arc = arcs.get(state * SPREAD + byte)
            if arc is None:
                if len(self.states) > 2 * self.most:  # within one long piece: the present state goes on
                    present = self.states[state]
                    self.forget()
                    state, arcs = self._state(*present), self.arcs
                arc = self._arc(state, byte)
            if arc < 0:
                state, emitted = self.emitted[~arc]
                out += emitted
            else:
                state = arc
        owed = self.states[state][1][-1]
        return [*out, *owed] if owed[0] >= 0 else out


class Utf8Machine:
    """UTF-8 decoding by states: bytes still missing, and the bounds of the next one.

    Feeding is incremental; broken sequences give U+FFFD, one for each maximal part.
    """

    def __init__(self):
        self.missing, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.missing:
            try:
                return data.decode()  # whole characters only: the state stays the same
            except UnicodeDecodeError:
                pass
        out = []
        for byte in data:
            if self.missing and not self.low <= byte <= self.high:
                out.append("�")
                self._reset()
            if self.missing:
                self.held.append(byte)
                self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                if not self.missing:
                    out.append(self.held.decode())
                    self._reset()
            elif byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.missing = 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.held.append(byte)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.missing else ""
        self._reset()
        return out

    def _reset(self) -> None:
        self.missing, self.low, self.high = 0, 0x80, 0xBF
        self.held.clear()


class Codec:
    """Encoder and decoder of one rank file, one per worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(self.ranks)
        self.pieces = Recent(self._piece, PIECES)
        self.bytes_of = self.transducer.tokens

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)  # a piece that is a token needs no merges
        return array("i", [whole] if whole is not None else self.transducer.run(data)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> str:
        """Text of ids, fed to the UTF-8 machine in blocks as a stream would."""
        machine, token, out = Utf8Machine(), self.bytes_of.__getitem__, []
        for i in range(0, len(ids), 4096):
            out.append(machine.feed(b"".join(map(token, ids[i : i + 4096]))))
        return "".join([*out, machine.close()])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    gc.set_threshold(SELDOM)  # its many small tuples hold no cycles, and looking for some took about an eighth of the time
    return Codec(path, pattern)


remembers("bpe", codec.cache_clear)


def _encoded(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    claim("bpe")
    encode = codec(path, pattern).encode
    parts = [encode(x) if x else b"" for x in texts.to_pylist()]
    return np.frombuffer(b"".join(parts), "i4"), np.array([len(x) // 4 for x in parts], np.int64)


def _decoded(ids: pa.ListArray, path: str, pattern: str) -> pa.Array:
    values, sizes = ragged(ids)
    ends, decode = np.cumsum(sizes), codec(path, pattern).decode
    return pa.array([decode(values[end - size : end].tolist()) for end, size in zip(ends, sizes)], pa.string())


def encode(text: str | Column, path: str, pattern: str) -> Column:
    """Ids of a text: each match of ``pattern`` encoded separately, no special tokens."""

    def ids(texts: pa.Array) -> pa.Array:
        return lists(*_encoded(texts, path, pattern), pa.int32())

    return F.arrow_udf(ids, "array<int>")(text)


def decode(ids: str | Column, path: str, pattern: str) -> Column:
    """Text of ids."""

    def text(arrays: pa.Array) -> pa.Array:
        return _decoded(arrays, path, pattern)

    return F.arrow_udf(text, "string")(ids)


def round_trip(text: str | Column, path: str, pattern: str) -> Column:
    """Ids of a text and the text decoded from them, in one pass of the workers."""

    def both(texts: pa.Array) -> pa.Array:
        ids = lists(*_encoded(texts, path, pattern), pa.int32())
        return pa.StructArray.from_arrays([ids, _decoded(ids, path, pattern)], ["ids", "decoded"])

    return F.arrow_udf(both, "struct<ids:array<int>,decoded:string>")(text)


def token_digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: id, number of tokens, and digests of the ids and of the decoded bytes; the ids too if wanted."""
    coded = docs.select("doc_id", round_trip("text", path, pattern).alias("coded"))
    return coded.select(
        "doc_id",
        *([F.col("coded.ids").alias("ids")] if with_ids else []),
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("coded.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("coded.decoded"), 256).alias("decoded_sha256"),
    )

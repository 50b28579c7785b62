"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

The merges become a finite-state transducer that reads bytes. Which tokens the merges give for a prefix
is fixed by the last of them, and a token may follow another only if the merges, run on the two together,
give back the two; so the transducer's state is the set of vocabulary entries that may still be in
progress, each with the token before it. States and transitions are made when a text first needs them
(lazy determinisation). What comes before the token that all entries of a state descend from is settled and emitted; it is
looked for whenever LOOKAHEAD bytes are pending, so a pre-token of any length streams through in bounded memory.

Most of a corpus repeats, so a task keeps the ids of the pieces between spaces. A single space before a
visible character always starts a new pre-token; texts in which white space is less simple are cut by the
pre-tokenizer's own pattern.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces, states and pairs of tokens that a task keeps; beyond that it starts anew.
KEPT_PIECES, KEPT_STATES, KEPT_PAIRS = 300_000, 300_000, 1_000_000
#: Bytes that may be pending before the transducer looks for what is settled.
LOOKAHEAD = 256
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = DEFAULT_FILE) -> dict[bytes, int]:
    """The vocabulary as bytes with ranks, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    """Bytes of one pre-token in, ids out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # Trie of the vocabulary: node * 256 + byte -> node.
        self.step: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, i in ranks.items():
            node = 0
            for b in token:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = i
        # A vocabulary entry that the merges can't build is never emitted.
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the states made so far."""
        self.states: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._state(((0, -1),))

    def _state(self, items: tuple) -> int:
        s = self.states.get(items)
        if s is None:
            s = self.states[items] = len(self.items)
            self.items.append(items)
            self.moves.append({})
        return s

    def merge(self, text: bytes) -> list[int]:
        """The merges by rank, as defined; used only to decide which tokens may follow each other."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave token ``b`` as it is after ``a`` (-1: at the start)."""
        if a < 0:
            ok = self.whole.get(b)
            if ok is None:
                ok = self.whole[b] = self.merge(self.bytes_of[b]) == [b]
            return ok
        key = a << 20 | b
        ok = self.pairs.get(key)
        if ok is None:
            ok = self.pairs[key] = self.follows(-1, b) and self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the last token of the prefix so far."""
        going, done = [], -1
        for node, before in self.items[state]:
            nxt = self.step.get(node << 8 | byte)
            if nxt is None:
                continue
            going.append((nxt, before))
            t = self.token_at[nxt]
            if t >= 0 and done < 0 and self.follows(before, t):
                done = t
        if done < 0:
            raise ValueError("the vocabulary lacks a single byte")
        # Entries that no byte can extend are dropped; one more entry may start here, after the token done.
        going.append((0, done))
        found = self.moves[state][byte] = (self._state(tuple(going)), done)
        return found

    def _back(self, pending: list[int], end: int) -> list[int]:
        """Where the tokens of the first ``end`` pending bytes end, the last first."""
        out = []
        while end > 0:
            out.append(end)
            end -= len(self.bytes_of[pending[end - 1]])
        return out

    def _settled(self, state: int, pending: list[int]) -> int:
        """How many pending bytes have the same tokens, whichever entry in progress goes on."""
        starts = {len(pending) - self.depth[node] for node, _ in self.items[state]}
        common = set(self._back(pending, max(starts)))
        for start in starts:
            common &= set(self._back(pending, start))
        return max(common, default=0)

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The ids of bytes as they come, each as soon as it is settled."""
        if len(self.items) > KEPT_STATES:
            self.forget()
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        state, limit = self.start, LOOKAHEAD
        pending: list[int] = []  # the last token of the text up to each byte
        moves = self.moves
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                move = self._move(state, byte)
            state, token = move
            pending.append(token)
            if len(pending) >= limit:
                done = self._settled(state, pending)
                for end in reversed(self._back(pending, done)):
                    yield pending[end - 1]
                del pending[:done]
                limit = len(pending) + LOOKAHEAD
        for end in reversed(self._back(pending, len(pending))):
            yield pending[end - 1]

    def encode(self, text: bytes) -> list[int]:
        return list(self.stream(text))


class Encoder:
    """Texts in, ids out; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.fst = Transducer(ranks)
        self.cut = regex.compile(PATTERN)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...] | None] = {}

    def _ids(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        words = self.words
        for w in self.cut.findall(text):
            ids = words.get(w)
            if ids is None:
                ids = tuple(self.fst.encode(w.encode("utf-8", "surrogatepass")))
                if len(w) <= 64:
                    if len(words) >= KEPT_PIECES:
                        words.clear()
                    words[w] = ids
            out.extend(ids)
        return tuple(out)

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of ``text``, as a list of tuples."""
        pieces = text.split(" ")
        if len(pieces) > 1:
            first = pieces[0]
            get = self.pieces.get
            ids = list(map(get, pieces[1:]))
            if None in ids:
                for i, found in enumerate(ids):
                    if found is None:
                        p = pieces[i + 1]
                        # Next to other white space a space need not start a pre-token.
                        if not p or p[0].isspace() or p[-1].isspace():
                            return [self._ids(text)]
                        if len(self.pieces) >= KEPT_PIECES:
                            self.pieces.clear()
                            get = self.pieces.get
                        ids[i] = self.pieces[p] = self._ids(" " + p)
            if first and not first[-1].isspace():
                ids.insert(0, self._ids(first))
                return ids
        return [self._ids(text)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))


_HERE: dict[str, Encoder] = {}


def worker_encoder(path: str, ranks) -> Encoder:
    """The encoder of this Python worker; ``ranks`` is a broadcast of the vocabulary (about 50,000 entries)."""
    if path not in _HERE:
        _HERE[path] = Encoder(ranks.value)
    return _HERE[path]


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_FILE, out: str = "ids", count_only: bool = False) -> DataFrame:
    """``key`` and the ids of ``text`` (or how many they are).

    Null and empty texts have an empty list. Special tokens' strings are ordinary text and no special
    token is added. Other columns are not read.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    kind = pa.int32() if count_only else pa.list_(pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, ranks)
        for batch in batches:
            sizes, flat = [0], []
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(encoder.parts(t)))
                sizes.append(len(flat))
            if count_only:
                values = pa.array(np.diff(np.array(sizes, dtype=np.int64)).astype(np.int32))
            else:
                values = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values.cast(kind)], names=[key, out])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, `{out}` {'int' if count_only else 'array<int>'}")


class Utf8Stream:
    """Bytes of a token stream to text as they come; a character that is not complete yet waits."""

    def __init__(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes, final: bool = False) -> str:
        return self.machine.decode(data, final)


def decode_column(df: DataFrame, key: str, ids: str, path: str = DEFAULT_FILE, out: str = "text") -> DataFrame:
    """``key`` and the text of ``ids``; no ids, or null, give an empty text."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            texts = []
            for row in batch.column(1).to_pylist():
                stream = Utf8Stream()
                texts.append("".join([*(stream.feed(bytes_of[i]) for i in row or ()), stream.feed(b"", True)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {key_type}, `{out}` string")

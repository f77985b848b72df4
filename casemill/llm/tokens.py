"""Encoding of texts with a public byte-level BPE tokenizer.

The merges are compiled into a finite-state transducer over bytes that is determinised lazily. A
state holds, for every start from which the bytes read so far may still grow into a token, the place
in the vocabulary's trie and the tokens chosen since the last one that all starts agree on. Reading a
byte moves every start along the trie; where a token ends and may follow the one before it, a new
start opens. Tokens that all open starts share are emitted at once, so the lookahead is bounded by
the longest token. States and transitions are memoised; ending a word in a state emits the rest.

That a token may follow another is decided by the merges themselves: a sequence of tokens is the
encoding of its bytes exactly if that holds for every two neighbours. Decoding streams: an incremental
UTF-8 state machine gives out characters as soon as their bytes are complete.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenisation pattern of the public byte-level BPE vocabularies; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to this length are remembered, up to this number of them per worker.
CACHE_WORD, CACHE_SIZE = 48, 200_000


def vocabulary_path(name: str = VOCABULARY, folder: str = "/opt/tokenizers") -> str:
    """Where the vocabulary file lies; the folder is a parameter."""
    return str(Path(folder) / name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ranks, which are their ids and the order of merges."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Transducer:
    """The lazily determinised transducer of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            at = 0
            for b in token:
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.children[at][b] = nxt
                at = nxt
            self.ends[at] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.state_of: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.rests: list[tuple[int, ...]] = []
        self.words: dict[str, list[int]] = {}
        self.start = self._intern(((0, (-1,)),))

    def _merged(self, data: bytes) -> list[bytes]:
        """The encoding of few bytes by merging the best pair again and again; only used to judge pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        fit = self.fits.get(key)
        if fit is None:
            b = self.tokens[right]
            a = self.tokens[left] if left >= 0 else b""
            fit = self._merged(a + b) == ([a, b] if a else [b])
            self.fits[key] = fit
        return fit

    def _intern(self, key: tuple) -> int:
        number = self.state_of.get(key)
        if number is None:
            number = len(self.states)
            self.state_of[key] = number
            self.states.append(key)
            self.moves.append({})
            self.rests.append(next((pending[1:] for node, pending in key if node == 0), ()))
        return number

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        grown, opened = [], None
        for node, pending in self.states[state]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.ends[nxt]
            if opened is None and token >= 0 and self._may_follow(pending[-1], token):
                opened = (*pending, token)
            if self.children[nxt]:
                grown.append((nxt, pending))
        if opened is None:
            raise ValueError("the vocabulary lacks single bytes")
        grown.append((0, opened))
        shared = 0
        shortest = min(len(p) for _, p in grown)
        while shared < shortest and all(p[shared] == opened[shared] for _, p in grown):
            shared += 1
        shared -= 1  # the last shared token stays as context
        result = (self._intern(tuple((node, p[shared:]) for node, p in grown)), opened[1 : shared + 1])
        self.moves[state][byte] = result
        return result

    def feed(self, data: Iterable[int], state: int | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(state, emitted tokens) after each byte, for streams."""
        state = self.start if state is None else state
        for byte in data:
            state, out = self.moves[state].get(byte) or self._move(state, byte)
            yield state, out

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        state, moves, out = self.start, self.moves, []
        for byte in word:
            hop = moves[state].get(byte)
            if hop is None:
                hop = self._move(state, byte)
            state = hop[0]
            if hop[1]:
                out += hop[1]
        out += self.rests[state]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for a null or empty text."""
        if not text:
            return []
        out: list[int] = []
        words = self.words
        for match in _SPLIT.finditer(text):
            word = match[0]
            ids = words.get(word)
            if ids is None:
                ids = self.encode_word(word.encode("utf-8", "replace"))
                if len(word) <= CACHE_WORD:
                    if len(words) >= CACHE_SIZE:
                        words.clear()
                    words[word] = ids
            out += ids
        if len(self.states) > 500_000:
            self.__init__(self.ranks)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by an incremental UTF-8 state machine; broken sequences become U+FFFD."""
        return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Pieces of text as soon as their bytes are complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.tokens[i]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece


_SPLIT = regex.compile(PATTERN)
_OPEN: dict[str, Transducer] = {}


def encoder(spark: SparkSession, path: str | None = None):
    """A function column -> column of ``array<int>``: null and empty texts give an empty list.

    The vocabulary file (a fixed size of about 0.8 MB) is read by the driver and broadcast, so that
    executors need no such file. Each Python worker compiles it once.
    """
    ranks = read_ranks(path or vocabulary_path())
    shared, key = spark.sparkContext.broadcast(ranks), f"{path or vocabulary_path()}:{len(ranks)}"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Transducer(shared.value)
        machine = _OPEN[key]
        return pd.Series([machine.encode(t if isinstance(t, str) else None) for t in texts], dtype=object)

    def apply(text: Column) -> Column:
        return encode(text.cast("string"))

    return apply

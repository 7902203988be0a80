"""Byte-level BPE as a lazily determinised finite-state transducer (problem 8), and its inverse.

A byte string has one BPE encoding, and an encoding is right exactly when each two neighbouring
tokens are the encoding of their joined bytes.  So the last token of the encoding of each prefix
is the one token that ends there and may follow the last token of what precedes it.  The
transducer's state holds, for each place where a token might have begun that is still open, the
node reached in the vocabulary trie and the tokens between the last emitted one and that place.
A token is emitted as soon as all open places agree on it, which is after a bounded lookahead:
no place older than the longest token is open.  States and their moves are made when first met
and kept; runs of letters that come up often are kept with their whole output.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quellwerk.llm.columns import struct_of

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts text into runs before byte-level merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: States, pairs of tokens and outputs kept at most; when more are met the tables are emptied and grow again.
MAX_STATES, MAX_FOLLOWS, MAX_RUNS = 120_000, 500_000, 300_000


class Transducer:
    """Encoder made from the ranks of a vocabulary ({bytes: id}, a lower id merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # trie: node -> {byte: node}; node -> token
        self.moves: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for text, token in ranks.items():
            node = 0
            for b in text:
                nxt = self.moves[node].get(b)
                if nxt is None:
                    nxt = self.moves[node][b] = len(self.moves)
                    self.moves.append({})
                    self.token_at.append(None)
                node = nxt
            if self.merge(text) == [token]:  # a token its own bytes don't encode to is never used
                self.token_at[node] = token
        self.follows: dict[tuple[int, int], bool] = {}
        self._reset()
        self.runs: dict[str, bytes] = {}

    def _reset(self, at: tuple | None = None) -> int:
        """Empty the tables but for the first state and `at`, whose new number is returned."""
        # a state: ((trie node, tokens pending before it), ...), oldest place first; the last emitted token
        first = (((0, ()),), -1)
        self.states: list[tuple] = [first, *([at] if at not in (None, first) else [])]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.step: list[dict[int, tuple[int, tuple]]] = [{} for _ in self.states]
        return len(self.states) - 1

    def merge(self, text: bytes) -> list[int]:
        """Encoding by the definition: join the pair of lowest rank until there is none.  For short strings."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of the bytes of a and b."""
        if a < 0:
            return True
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) >= MAX_FOLLOWS:
                self.follows.clear()
            known = self.follows[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        places, emitted = self.states[state]
        after, done = [], None
        for node, pending in places:
            node = self.moves[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token is not None and done is None and self.may_follow(pending[-1] if pending else emitted, token):
                done = (*pending, token)
            if self.moves[node]:
                after.append((node, pending))
        if done is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        after.append((0, done))
        first, k = after[0][1], 0
        while k < len(first) and all(len(p) > k and p[k] == first[k] for _, p in after):
            k += 1
        out = first[:k]
        new = (tuple((n, p[k:]) for n, p in after), out[-1] if out else emitted)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            self.step.append({})
        self.step[state][byte] = result = (number, out)
        return result

    def encode_run(self, run: bytes) -> list[int]:
        """Ids of one run, of any length: when the tables are full, they start again from the state reached."""
        state, out = 0, []
        for byte in run:
            found = self.step[state].get(byte)
            if found is None:
                if len(self.states) >= MAX_STATES:
                    state = self._reset(self.states[state])
                found = self._move(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        out += self.states[state][0][-1][1]
        return out

    def packed(self, run: str) -> bytes:
        ids = np.array(self.encode_run(run.encode("utf-8", "surrogatepass")), np.int32).tobytes()
        if len(run) <= 40:
            if len(self.runs) >= MAX_RUNS:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def encode_packed(self, text: str) -> bytes:
        """Ids of `text` as 32-bit integers."""
        get, packed = self.runs.get, self.packed
        return b"".join([get(r) or packed(r) for r in RUNS(text)])

    def encode(self, text: str | None) -> list[int]:
        """Ids of `text`; None and "" give []."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist() if text else []

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of `ids`, piece by piece: an incremental UTF-8 machine holds back unfinished characters."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.tokens[i]):
                yield piece
        if piece := machine.decode(b"", True):
            yield piece


RUNS = regex.compile(PATTERN).findall
_MADE: dict[int, Transducer] = {}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Tokenizer:
    """Handle of a vocabulary file: sent to the executors once, compiled once in each Python worker."""

    def __init__(self, spark, path: str = f"{TOKENIZERS}/{BYTE_BPE}"):
        with open(path, "rb") as f:
            raw = f.read()
        self.key = hash(raw)
        self.shared = spark.sparkContext.broadcast(raw)  # a vocabulary file, under 1 MB

    def get(self) -> Transducer:
        if self.key not in _MADE:
            _MADE.clear()
            _MADE[self.key] = Transducer(read_ranks(self.shared.value))
        return _MADE[self.key]

    def __getstate__(self):
        return {"key": self.key, "shared": self.shared}


def encode(df: DataFrame, tokenizer: Tokenizer, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of each row; null and empty texts have the ids [] (problem 8).

    One narrow pass: whole texts go through Arrow, ids come back as flat 32-bit arrays.
    """
    df = df.select(id, text)
    schema = struct_of(df, [id], ids=T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.get()
        for b in batches:
            # cut so that one output array stays small whatever the texts' length
            for lo, hi in _slices(b.column(1)):
                packed = [coder.encode_packed(t) if t else b"" for t in b.column(1)[lo:hi].to_pylist()]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], ids], names=schema.names)

    return df.mapInArrow(run, schema)


def _slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size > most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def count_tokens(df: DataFrame, tokenizer: Tokenizer, id: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, keep, tokens) of each row; null and empty texts have 0 tokens."""
    df = df.select(id, text, *keep)
    schema = struct_of(df, [id, *keep], tokens=T.LongType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.get()
        for b in batches:
            n = [len(coder.encode_packed(t)) // 4 if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)

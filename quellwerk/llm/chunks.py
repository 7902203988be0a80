"""Splitting oversized texts at natural boundaries (problem 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quellwerk.llm.bpe import PATTERN, Tokenizer, Transducer
from quellwerk.llm.columns import struct_of

LIMIT, OVERLAP = 4096, 128
#: Runs hashed together for a landmark; a landmark stands at about one run in LANDMARK_EVERY.
WINDOW, LANDMARK_EVERY = 16, 512
#: A better kind of boundary is preferred within so many tokens of the landmark.
SNAP = 384
PARAGRAPH, LINE, SENTENCE, WORD = 3, 2, 1, 0
_RUNS = regex.compile(PATTERN)
_SENTENCE_END = regex.compile(r"[.!?…。！？][\"'»”“’)\]]*$")


@dataclass
class Piece:
    start: int  # of the part that is new
    end: int
    lead: int  # where the repeated part before it starts
    tokens: int  # of text[lead:end]


def _runs(text: str, coder: Transducer, longest: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Start, tokens, kind of the boundary before, and landmark hash of each run; overlong runs are cut."""
    starts, sizes, kinds, hashes = [], [], [], []
    hash_ = 0
    recent: list[int] = []
    before = ""
    for m in _RUNS.finditer(text):
        run = m.group()
        n = len(coder.runs.get(run) or coder.packed(run)) // 4
        parts = [(m.start(), n)]
        if n > longest:  # a single run beyond the limit has no natural boundary inside
            step = max(1, longest // 4)  # a character is at most 4 bytes, a byte at most one token
            parts = [(m.start() + i, len(coder.encode(run[i:i + step]))) for i in range(0, len(run), step)]
        newlines = before.count("\n")
        kind = (PARAGRAPH if newlines > 1 else LINE if newlines else SENTENCE if run[:1].isspace() and _SENTENCE_END.search(before) else WORD)
        for i, (at, size) in enumerate(parts):
            # rolling hash over the last WINDOW runs
            h = zlib.crc32(text[at:at + 64].encode("utf-8", "surrogatepass") if i else run[:64].encode("utf-8", "surrogatepass"))
            recent.append(h)
            hash_ = (hash_ * 31 + h) & 0xFFFFFFFFFFFF
            if len(recent) > WINDOW:
                hash_ = (hash_ - recent[-WINDOW - 1] * _DROP) & 0xFFFFFFFFFFFF
            starts.append(at)
            sizes.append(size)
            kinds.append(kind if not i else -1)
            hashes.append(hash_)
        # closing quotes after a stop, and white space after newlines, belong to the boundary before
        before = (before + run)[-8:] if not run.strip() or _SENTENCE_END.search((before + run)[-8:]) else run[-8:]
    return starts, sizes, kinds, hashes


_DROP = pow(31, WINDOW, 1 << 48)


def split_text(text: str, coder: Transducer, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Piece]:
    """Pieces of `text`, each of at most `limit` tokens; [] for None and "", one piece if it fits.

    From the start of a piece, the first landmark (a place where a rolling hash of the runs
    before it has a certain value) between half of the room and all of it is looked for; the cut is
    the best kind of boundary (paragraph, line, sentence, word) within SNAP tokens of it, the
    nearest of that kind.  Without a landmark the end of the room stands for it.  Landmarks
    depend on nearby text only, so an edit moves the cuts beside it and the later ones stay.
    Each piece but the first repeats the longest tail of the one before that starts at a run and
    has at most `overlap` tokens.
    """
    if not text:
        return []
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    whole = len(coder.encode_packed(text)) // 4
    if whole <= limit:
        return [Piece(0, len(text), 0, whole)]
    slack = 8  # white space at a cut may be tokenized differently in the piece
    room = limit - overlap - slack
    starts, sizes, kinds, hashes = _runs(text, coder, room // 2)
    n = len(starts)
    at = np.concatenate(([0], np.cumsum(sizes)))  # tokens before each run
    kind = np.array([*kinds, PARAGRAPH])
    # the boundary before run i is a landmark if the hash up to run i - 1 says so
    marks = np.flatnonzero(np.array(hashes) % LANDMARK_EVERY == 0) + 1
    chars = [*starts, len(text)]
    pieces: list[Piece] = []
    first = 0
    while first < n:
        if at[n] - at[first] <= room:
            cut = n
        else:
            lo = int(np.searchsorted(at, at[first] + room // 2, "left"))
            hi = int(np.searchsorted(at, at[first] + room, "right")) - 1
            k = int(np.searchsorted(marks, lo, "left"))
            mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
            a = max(lo, int(np.searchsorted(at, at[mark] - SNAP, "left")))
            b = min(hi, int(np.searchsorted(at, at[mark] + SNAP, "right")) - 1)
            near = np.arange(a, b + 1)
            best = near[kind[near] == kind[near].max()]
            cut = int(best[np.argmin(np.abs(at[best] - at[mark]))])
        lead = first
        while lead > 0 and at[first] - at[lead - 1] <= overlap and pieces:
            lead -= 1
        lead = max(lead, 0)
        if pieces:
            lead = max(lead, int(np.searchsorted(chars, pieces[-1].start)))
        while True:
            tokens = len(coder.encode_packed(text[chars[lead]:chars[cut]])) // 4
            if tokens <= limit:
                break
            if lead < first:
                lead += 1
            else:
                cut -= 1
        pieces.append(Piece(chars[first], chars[cut], chars[lead], tokens))
        first = cut
    return pieces


def split_oversized(df: DataFrame, tokenizer: Tokenizer, limit: int = LIMIT, overlap: int = OVERLAP, id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """Pieces of each text of more than `limit` tokens (problem 10).

    (id, piece, start, end, lead, tokens, piece_text): piece counts from 0; [start, end) is the
    new part in code points, so the new parts together are the text; piece_text begins at `lead`
    with what it repeats of the piece before.  Texts within the limit, null and empty texts give
    no rows.  A text has at least as many bytes as tokens: texts of at most `limit` bytes are
    passed over without being tokenized.
    """
    df = df.select(id, text)
    schema = struct_of(df, [id], piece=T.IntegerType(), start=T.LongType(), end=T.LongType(), lead=T.LongType(), tokens=T.IntegerType(),
                       piece_text=T.StringType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer.get()
        for b in batches:
            large = pc.fill_null(pc.greater(pc.binary_length(b.column(1)), limit), False)
            for i, t in zip(b.column(0).filter(large), b.column(1).filter(large), strict=True):
                t = t.as_py()
                pieces = split_text(t, coder, limit, overlap)
                if len(pieces) < 2:
                    continue
                yield pa.RecordBatch.from_arrays([
                    pa.array([i.as_py()] * len(pieces), b.column(0).type), pa.array(range(len(pieces)), pa.int32()),
                    *(pa.array([getattr(p, k) for p in pieces], pa.int64()) for k in ("start", "end", "lead")),
                    pa.array([p.tokens for p in pieces], pa.int32()), pa.array([t[p.lead:p.end] for p in pieces])], names=schema.names)

    return df.mapInArrow(run, schema)

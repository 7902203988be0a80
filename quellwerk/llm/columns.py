"""Text analysis over whole Arrow batches.

A batch of texts is turned into one array of UTF-16 units; character classes, lower-casing,
letters, words and their hashes are then table look-ups and segment sums over that array.  Only
rows whose characters may be changed by the consistent form, or that may be garbled, are looked
at one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quellwerk.llm import form as M

_CHARS = [chr(i) if not 0xD800 <= i < 0xE000 else "" for i in range(0x10000)]
ALNUM = np.array([c.isalnum() for c in _CHARS])
LOWER = np.array([ord(c.lower()[0]) if c else i for i, c in enumerate(_CHARS)], np.uint16)
_PLAIN_CHARS = ("\t\n\r" + "".join(map(chr, range(32, 127))) + "".join(map(chr, range(ord("А"), ord("я") + 1)))
                + "ЁёІіЇїЄєҐґÄÖÜäöüß«»“”„’‘–—")
ODD = np.ones(0x10000, bool)
ODD[[ord(c) for c in _PLAIN_CHARS]] = False
LATIN = np.array([c in _PLAIN_CHARS and c.isalpha() and c < "Ͱ" and c != "" for c in _CHARS])
CYRILLIC = np.array([c in _PLAIN_CHARS and "Ѐ" <= c <= "ӿ" and c != "" for c in _CHARS])
UPPER = CYRILLIC & np.array([c.isupper() for c in _CHARS])
#: Class of a character for the letter histogram.
BIN = np.array([i % 8 for i in range(0x10000)], np.int64)


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all texts in a row, and the offset of each text (one more than texts).  Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
    raw = memoryview(texts.buffers()[2])[offsets[0]:offsets[-1]]
    codes = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-16-le"), np.uint16)
    lead = np.frombuffer(raw, np.uint8)
    at = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(((lead & 0xC0) != 0x80).astype(np.int8) + (lead >= 0xF0), out=at[1:])
    return codes, at[offsets - offsets[0]]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` within each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def irregular(texts: pa.Array) -> np.ndarray:
    """Which texts may differ from their consistent form, or be garbled."""
    codes, offsets = units(texts)
    if not len(codes):
        return np.zeros(len(texts), bool)
    bad = ODD[codes]
    latin, cyrillic, upper = LATIN[codes], CYRILLIC[codes], UPPER[codes]
    lower = cyrillic & ~upper
    # pairs across two rows only make a row be looked at in vain
    bad[1:] |= latin[:-1] & cyrillic[1:] | cyrillic[:-1] & latin[1:] | lower[:-1] & upper[1:]
    bad[2:] |= upper[:-2] & upper[1:-1] & upper[2:]
    # a mark such as &#1078; or \\u0436
    bad[1:] |= (codes[:-1] == ord("&")) & ((codes[1:] == ord("#")) | latin[1:])
    bad[1:] |= (codes[:-1] == ord("\\")) & ((codes[1:] == ord("u")) | (codes[1:] == ord("x")))
    found = np.zeros(len(texts), bool)
    found[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return found


def inspect(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(garbled?, consistent form) of each text; the form is null where the text is null or garbled."""
    from quellwerk.llm import garble

    where = np.flatnonzero(irregular(texts))
    garbled = np.zeros(len(texts), bool)
    if not len(where):
        return garbled, texts
    forms = []
    for i, t in zip(where, texts.take(pa.array(where)).to_pylist(), strict=True):
        garbled[i] = garble.garbled(t)
        forms.append(None if garbled[i] else M.consistent(t))
    mask = np.zeros(len(texts), bool)
    mask[where] = True
    return garbled, pc.replace_with_mask(texts, pa.array(mask), pa.array(forms, texts.type))


class Letters:
    """Letters and words of a batch of forms."""

    def __init__(self, forms: pa.Array):
        self.n = len(forms)
        codes, offsets = units(forms)
        low = LOWER[codes]
        alnum = ALNUM[codes] | ((codes >= 0xD800) & (codes < 0xE000))
        if ((codes >= 0xD800) & (codes < 0xDC00)).any():  # letters beyond 16 bits: settle them one by one
            for i in np.flatnonzero((codes >= 0xD800) & (codes < 0xDC00)):
                c = codes[i:i + 2].tobytes().decode("utf-16-le")
                alnum[i:i + 2] = c.isalnum()
                low[i:i + 2] = np.frombuffer(c.lower().encode("utf-16-le")[:4], np.uint16)
        self.count = row_sums(alnum, offsets)  # letters of each row
        self.codes = low[alnum]
        self.offsets = np.concatenate(([0], np.cumsum(self.count)))
        self._alnum, self._low, self._rows = alnum, low, offsets

    def cheap(self) -> np.ndarray:
        """Number made of the length and the letter histogram of each row's letters."""
        h = self.count.astype(np.uint64)
        for b in range(8):
            h = _mix(h * np.uint64(0x100000001B3) + row_sums(BIN[self.codes] == b, self.offsets).astype(np.uint64))
        return h.view(np.int64)

    def strings(self) -> list[bytes]:
        raw = self.codes.tobytes()
        return [raw[2 * a:2 * b] for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]

    def digests(self) -> list[bytes | None]:
        """128-bit digest of each row's letters, None where there are none."""
        return [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in self.strings()]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct 64-bit word hashes of all rows in a row, offsets)."""
        a = self._alnum
        start = a.copy()
        start[1:] &= ~a[:-1]
        firsts = self._rows[:-1][np.diff(self._rows) > 0]
        start[firsts] |= a[firsts]
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        picked = np.flatnonzero(a)
        word = np.cumsum(start[picked]) - 1
        within = picked - starts[word]
        powers = _powers(int(within.max()) + 1)
        parts = (self._low[picked].astype(np.uint64) + np.uint64(1)) * powers[within]
        firsts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        hashes = _mix(np.add.reduceat(parts, firsts))
        row = np.searchsorted(self._rows, starts, "right") - 1
        order = np.argsort(hashes)  # by hash, then by row
        order = order[np.argsort(row[order].astype(np.uint16) if self.n <= 1 << 16 else row[order], kind="stable")]
        row, hashes = row[order], hashes[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes = row[keep], hashes[keep]
        return hashes.view(np.int64), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.n))))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15 | 1, np.uint64)) if n else _POWERS
    return _POWERS


def map_batches(df: DataFrame, schema: T.StructType, one) -> DataFrame:
    """`one(batch) -> pa.RecordBatch` over each Arrow batch of `df`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield one(b)

    return df.mapInArrow(run, schema)


def struct_of(df: DataFrame, names: list[str], **more: T.DataType) -> T.StructType:
    """Schema of the columns `names` of `df` and `more`."""
    return T.StructType([df.schema[n] for n in names] + [T.StructField(k, v) for k, v in more.items()])


def garbled_rows(df: DataFrame, id: str = "anecdote_id", text: str = "text", repaired: bool = False) -> DataFrame:
    """`id` of each garbled row, with `repaired` its text as it was meant (problem 1)."""
    df = df.select(id, text)
    schema = struct_of(df, [id], **({"repaired": T.StringType()} if repaired else {}))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        from quellwerk.llm.garble import repair

        where = np.flatnonzero(irregular(b.column(1)))
        found = [(i, r[1]) for i, t in zip(where, b.column(1).take(pa.array(where)).to_pylist(), strict=True) if (r := repair(t))[0]]
        ids = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *([pa.array([t for _, t in found], pa.string())] if repaired else [])], names=schema.names)

    return map_batches(df, schema, one)

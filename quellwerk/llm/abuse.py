"""Abusive, hateful or sexual content by nearest labelled examples (problem 3).

A record is a set of segments: the sentences of its text and its tags.  Each segment is compared
with labelled segments by the cosine of their TF-IDF vectors; its nearest examples vote, weighted
by nearness, and the record's score is that of its worst segment.  The examples lie in an inverted
index cut into blocks, which keeps for each word the largest weight in each block: a block whose
bound cannot reach the k-th best so far is skipped, so the neighbours are exact.  The same
bound over the abusive examples alone (a segment that comes near none of them scores 0) settles
nearly all segments without a search.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm import form as M
from quellwerk.llm.columns import _CHARS, ALNUM, LOWER, _mix, _powers, irregular, map_batches, row_sums, struct_of, units
from quellwerk.session import written

#: Labelled records the index is fitted on at most, chosen by the hash of their id.
SAMPLE = 20_000
NEIGHBOURS, NEAR, BLOCK = 9, 0.5, 64
THRESHOLD = 0.5
#: A segment of an abusive record counts as abusive from this rate of abusive records among those of its most telling word.
TELLING = 0.55

# Signs written for letters, in Cyrillic and in Latin words; letters of one script
# that stand for another's in words that mix scripts anyway.
LEET_CYRILLIC = str.maketrans("0@3461$", "оазчбіс")
LEET_LATIN = str.maketrans("0@3451$", "oaeasis")
LOOSE_TO_CYRILLIC = str.maketrans("ktmhbnru", "ктмнвпги")
LOOSE_TO_LATIN = str.maketrans("ктмнвпги", "ktmhbnru")

_SPACED = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:([ ._\-*])\p{L})(?:\1\p{L})+(?![\p{L}\p{N}])")
_SIGNS = regex.compile(r"[\p{L}\p{N}@*$]*\p{L}[\p{L}\p{N}@*$]*")
_STRETCHED = regex.compile(r"(\p{L})\1{2,}")
_SEGMENTS = re.compile(r"(?<=[.!?…])[\"'»”“’)\]]*\s+|\n+")
_TOKENS = regex.compile(r"[\p{L}\p{N}*]*\p{L}[\p{L}\p{N}*]*")
_WORDS = re.compile(r"[^\W\d_]+")
ALPHA = np.array([c.isalpha() for c in _CHARS])
SIGN = np.isin(np.arange(0x10000), [ord(c) for c in "@*$"])
GAP = np.isin(np.arange(0x10000), [ord(c) for c in " ._-*"])


def disguised(texts: pa.Array) -> np.ndarray:
    """Which texts may hold spaced, stretched or sign-for-letter spellings, or are irregular otherwise."""
    found = irregular(texts)
    codes, offsets = units(texts)
    if not len(codes):
        return found
    alpha, alnum, low = ALPHA[codes], ALNUM[codes], LOWER[codes]
    hit = SIGN[codes]
    hit[1:] |= (alpha[1:] != alpha[:-1]) & alnum[1:] & alnum[:-1]
    hit[2:] |= alpha[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    if len(codes) > 4:
        gap = GAP[codes]
        alone = alpha.copy()
        alone[1:] &= ~alnum[:-1]
        alone[:-1] &= ~alnum[1:]
        hit[4:] |= alone[4:] & gap[3:-1] & alone[2:-2] & gap[1:-3] & alone[:-4]
    return found | (row_sums(hit, offsets) > 0)


def _unmask(m: regex.Match) -> str:
    w = m.group()
    if w.isalpha() and not M._TWO.search(w):
        return w
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in w)
    latin = sum(c.isalpha() for c in w) - cyrillic
    w = w.translate(LEET_CYRILLIC if cyrillic > latin else LEET_LATIN) if not w.isdigit() else w
    if cyrillic and latin:
        w = M.fold_word(w)
        w = w.translate(LOOSE_TO_CYRILLIC if cyrillic > latin else LOOSE_TO_LATIN)
    return w


def unmasked(text: str) -> str:
    """Lower-cased consistent form with spaced, stretched and sign-for-letter spellings undone."""
    text = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text.lower())
    return _STRETCHED.sub(r"\1", _SIGNS.sub(_unmask, text))


_TAGS: dict[str, tuple[str, ...]] = {}


def tag_tokens(tag: str) -> tuple[str, ...]:
    """Tokens of a tag, marked with # to keep them apart from those of sentences."""
    found = _TAGS.get(tag)
    if found is None:
        if len(_TAGS) > 50_000:
            _TAGS.clear()
        found = _TAGS[tag] = tuple(dict.fromkeys("#" + w for w in _TOKENS.findall(unmasked(M.consistent(tag)))))
    return found


def segments(text: str | None, tags: list[str] | None, odd: bool = True) -> list[tuple[str, ...]]:
    """Token tuples of a record's sentences and tags.  `odd` says that the text may be disguised or garbled."""
    out = []
    if text and odd:
        from quellwerk.llm.garble import repair

        out = [tuple(dict.fromkeys(_TOKENS.findall(s))) for s in _SEGMENTS.split(unmasked(M.consistent(repair(text)[1])))]
    elif text:
        out = [tuple(dict.fromkeys(_WORDS.findall(s))) for s in _SEGMENTS.split(text.lower())]
    out += [tag_tokens(t) for t in tags or () if t]
    return [s for s in out if s]


_ENDS, _QUOTES, _BLANK = (np.isin(np.arange(0x10000), [ord(c) for c in x]) for x in (".!?…", "\"'»”“’)]", " \t\n\r"))


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment, hash) of each word of texts that aren't disguised: what `segments` finds, as arrays for a whole batch."""
    codes, offsets = units(texts)
    alpha = ALPHA[codes]
    start = alpha.copy()
    start[1:] &= ~alpha[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start[firsts] |= alpha[firsts]
    starts = np.flatnonzero(start)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    # a segment ends at a new line, and at white space after a stop and what quotes follow it
    solid = np.maximum.accumulate(np.where(_QUOTES[codes], -1, np.arange(len(codes))))
    cut = codes == 10
    before = solid[:-1]
    cut[1:] |= _BLANK[codes[1:]] & (before >= 0) & _ENDS[codes[before]]
    cut[firsts] = True
    picked = np.flatnonzero(alpha)
    word = np.cumsum(start[picked]) - 1
    within = picked - starts[word]
    parts = (LOWER[codes[picked]].astype(np.uint64) + np.uint64(1)) * _powers(int(within.max()) + 1)[within]
    hashes = _mix(np.add.reduceat(parts, np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))))
    return np.searchsorted(offsets, starts, "right") - 1, np.cumsum(cut)[starts], hashes


def _segments_of(b: pa.RecordBatch, text: int, tags: int) -> Iterator[list[tuple[str, ...]]]:
    for t, g, o in zip(b.column(text).to_pylist(), b.column(tags).to_pylist(), disguised(b.column(text)), strict=True):
        yield segments(t, g, bool(o))


class Examples:
    """Labelled segments in a block-max inverted index."""

    def __init__(self, records: list[tuple[bool, list[tuple[str, ...]]]], telling: float = TELLING):
        """`records`: (abusive?, segments).

        A label belongs to the record, not to each of its segments.  A segment of an abusive
        record is taken as abusive if one of its words is found in abusive records mostly;
        the record's other segments are left out.  All segments of other records are harmless.
        Some labels are wrong, so a segment's share of abuse is its votes smoothed by the rate of
        its most telling word.
        """
        pos, neg = Counter(), Counter()
        for abusive, segs in records:
            (pos if abusive else neg).update({w for s in segs for w in s})
        base = (sum(y for y, _ in records) + 1) / (len(records) + 2)
        rate = {w: (n + 3 * base) / (n + neg[w] + 3) for w, n in pos.items()}
        self.segs: dict[tuple[str, ...], list[float]] = {}
        for abusive, segs in records:
            for s in map(tuple, map(sorted, segs)):
                if not abusive or max((rate.get(w, 0.0) for w in s), default=0.0) >= telling:
                    self.segs.setdefault(s, [0, 0])[abusive] += 1
        self.telling = {s: max((rate.get(w, 0.0) for w in s), default=0.0) for s in self.segs}
        # words that one record alone has say nothing
        words = sorted({w for s in self.segs for w in s if pos[w] + neg[w] > 1})
        self.words = {w: i for i, w in enumerate(words)}
        plain = pa.array([w for w in words if _WORDS.fullmatch(w)], pa.string())
        hashes = np.zeros(0, np.uint64)
        if len(plain):
            hashes = _words_of(plain)[2]
        o = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[o], np.array([self.words[w] for w in plain.to_pylist()], np.int64)[o]
        abusive = {w for s, (_, y) in self.segs.items() if y for w in s if w in self.words}
        self.masked: dict[int, list[str]] = {}
        for w in sorted(abusive):
            if len(w) > 3:
                self.masked.setdefault(len(w), []).append(w)

    def fit(self, counts: dict[str, int], total: int) -> Examples:
        """Weights from the number of records of the whole corpus that have each word."""
        self.idf = np.array([math.log((total + 1) / (counts.get(w, 0) + 1)) + 0.1 for w in self.words])
        rows = []
        for s, (n, y) in self.segs.items():
            ids = self._ids(s)
            if ids:
                rows.append((y == 0, sorted(ids, key=lambda i: -self.idf[i]), n, y, (y + self.telling[s]) / (n + y + 1)))
        rows.sort(key=lambda r: (r[0], r[1]))  # abusive ones first, alike ones side by side
        self.votes = np.array([r[2:4] for r in rows], float).reshape(len(rows), 2)
        self.share = np.array([r[4] for r in rows])
        lengths = [len(r[1]) for r in rows]
        self.row = np.repeat(np.arange(len(rows)), lengths)
        self.term = np.array([i for r in rows for i in r[1]], np.int64)
        w = self.idf[self.term] if len(self.term) else np.zeros(0)
        norm = np.sqrt(np.bincount(self.row, w * w, len(rows)))
        self.weight = w / norm[self.row] if len(rows) else w
        self.start = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        # block maxima as postings: word -> (blocks, largest weight in each)
        block = self.row // BLOCK
        self.blocks = int(block.max()) + 1 if len(block) else 0
        key = self.term * max(self.blocks, 1) + block
        o = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[o][1:] != key[o][:-1]))) if len(o) else np.zeros(0, np.int64)
        self.b_max = np.maximum.reduceat(self.weight[o], first) if len(first) else np.zeros(0)
        self.b_block = (key[o][first] % max(self.blocks, 1)) if len(first) else np.zeros(0, np.int64)
        self.b_start = np.searchsorted(key[o][first] // max(self.blocks, 1) if len(first) else first, np.arange(len(self.words) + 1))
        # the bound over all abusive examples together
        self.top = np.zeros(len(self.words))
        bad = self.votes[self.row, 1] > 0 if len(rows) else np.zeros(0, bool)
        np.maximum.at(self.top, self.term[bad], self.weight[bad])
        self.known: dict[tuple[int, ...], tuple[float, tuple | None]] = {}
        return self

    def _ids(self, seg: Iterable[str]) -> list[int]:
        out = set()
        for w in seg:
            i = self.words.get(w)
            if i is None and "*" in w:  # a sign hides a letter: the one abusive word that fits
                p = regex.compile(regex.escape(w).replace(r"\*", ".") + "$")
                fits = [x for x in self.masked.get(len(w), ()) if p.match(x)]
                i = self.words[fits[0]] if len(fits) == 1 else None
            if i is not None:
                out.add(i)
        return sorted(out)

    def neighbours(self, ids: list[int]) -> list[tuple[float, int]]:
        """(cosine, example) of the NEIGHBOURS nearest examples, those at NEAR and above."""
        q = self.idf[ids]
        q = q / math.sqrt(float((q * q).sum()))
        bound = np.zeros(self.blocks)
        for i, w in zip(ids, q, strict=True):
            a, b = self.b_start[i], self.b_start[i + 1]
            bound[self.b_block[a:b]] += w * self.b_max[a:b]
        full = np.zeros(len(self.words))
        full[ids] = q
        best: list[tuple[float, int]] = []
        order = np.argsort(-bound, kind="stable")
        for b in order[bound[order] >= NEAR]:
            if len(best) == NEIGHBOURS and bound[b] < best[-1][0]:
                break
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.votes))
            a, z = self.start[lo], self.start[hi]
            cos = np.bincount(self.row[a:z] - lo, self.weight[a:z] * full[self.term[a:z]], hi - lo)
            best += [(float(c), int(lo + k)) for k, c in enumerate(cos) if c >= NEAR]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:NEIGHBOURS]
        return best

    def term_text(self, example: int) -> list[str]:
        """Words of an example, weightiest first."""
        if not hasattr(self, "names"):
            self.names = list(self.words)
        return [self.names[t] for t in self.term[self.start[example]:self.start[example + 1]]]

    def told(self, texts: pa.Array, tags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, segment, word) of all known words of a batch, ordered, each once a segment."""
        odd = disguised(texts)
        plain = np.flatnonzero(~odd)
        row, seg, hashes = _words_of(texts.take(pa.array(plain)))
        k = np.searchsorted(self.hashes, hashes)
        k[k == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[k] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        rows, segs, ids = [plain[row[hit]]], [seg[hit]], [self.of_hash[k[hit]] if len(hit) else np.zeros(0, np.int64)]
        n = int(seg[-1]) + 1 if len(seg) else 0
        more: list[tuple[int, int, int]] = []
        where = np.flatnonzero(odd)
        slow = [(i, segments(t, None, True)) for i, t in zip(where, texts.take(pa.array(where)).to_pylist(), strict=True)]
        known: dict[str, list[int]] = {}
        for i, g in enumerate(tags.to_pylist()):
            for t in g or ():
                if t:
                    found = known.get(t)
                    if found is None:
                        found = known[t] = self._ids(tag_tokens(t))
                    if found:
                        more += [(i, n, x) for x in found]
                        n += 1
        for i, segs_ in slow:
            for s in segs_:
                if found := self._ids(s):
                    more += [(i, n, x) for x in found]
                    n += 1
        if more:
            extra = np.array(more, np.int64)
            rows, segs, ids = [*rows, extra[:, 0]], [*segs, extra[:, 1]], [*ids, extra[:, 2]]
        row, seg, word = map(np.concatenate, (rows, segs, ids))
        o = np.lexsort((word, seg, row))
        row, seg, word = row[o], seg[o], word[o]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]) | (word[1:] != word[:-1])
        return row[keep], seg[keep], word[keep]

    def score(self, seg: tuple[str, ...]) -> tuple[float, tuple[int, float] | None]:
        """(score in [0, 1], (nearest abusive example, its cosine)) of a segment; 0 without a near abusive example."""
        ids = self._ids(seg)
        return self.score_of(ids) if ids and self.may_score(np.array(ids), np.zeros(1, np.int64))[0] else (0.0, None)

    def may_score(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which segments (ranges of `words`) can come near an abusive example at all."""
        idf = self.idf[words]
        norm, most = np.add.reduceat(idf * idf, starts), np.add.reduceat(idf * self.top[words], starts)
        return most >= NEAR * np.sqrt(norm) * (1 - 1e-12)

    def score_of(self, ids: list[int]) -> tuple[float, tuple[int, float] | None]:
        key = tuple(ids)
        known = self.known.get(key)
        if known is None:
            near = self.neighbours(ids)
            weights = np.array([c**4 for c, _ in near])
            share = self.share[[e for _, e in near]] if near else np.zeros(0)
            evidence = next(((e, c) for c, e in near if self.votes[e, 1] > 0), None)
            value = float((weights * share).sum() / (weights.sum() + 0.02)) if near else 0.0
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[key] = (value, evidence)
        return known


def labelled(records: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """(id, text, tags, abusive) by the majority of each record's judgements; ties and nulls are left out."""
    votes = (labels.filter(F.col("abusive").isNotNull()).groupBy(id).agg(F.avg("abusive").alias("_y"))
             .filter(F.col("_y") != 0.5).select(id, (F.col("_y") > 0.5).alias("abusive")))
    votes = votes.orderBy(F.xxhash64(id)).limit(SAMPLE)
    return records.select(id, "text", "tags").join(F.broadcast(votes), id)


def examples_of(records: DataFrame, labels: DataFrame, id: str = "anecdote_id", telling: float = TELLING) -> Examples:
    """Index of the labelled records (at most SAMPLE), not weighted yet."""
    schema = T.StructType([T.StructField("abusive", T.BooleanType()), T.StructField("segments", T.ArrayType(T.StringType()))])

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        segs = [[" ".join(s) for s in x] for x in _segments_of(b, 1, 2)]
        return pa.RecordBatch.from_arrays([b.column(3), pa.array(segs, pa.list_(pa.string()))], names=schema.names)

    rows = map_batches(labelled(records, labels, id), schema, cut).toPandas()
    return Examples([(bool(y), [tuple(s.split(" ")) for s in segs]) for y, segs in zip(rows["abusive"], rows["segments"], strict=True)], telling)


def _told(records: DataFrame, examples: Examples, keep: list[str]) -> DataFrame:
    """The known words of each record by segments, from one pass over the texts: (keep, _words, _segments, _counts).

    The last row of each task has `_counts`: in how many of its records each word is found (in
    `_segments`, by word), and the number of records as word -1.
    """
    shared = records.sparkSession.sparkContext.broadcast(examples)  # bounded by SAMPLE records
    df = records.select("text", "tags", *keep)
    numbers = T.ArrayType(T.LongType(), False)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField("_words", numbers), T.StructField("_segments", numbers),
                           T.StructField("_counts", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kinds = shared.value, None
        found, total = np.zeros(len(index.words), np.int64), 0
        for b in batches:
            if not b.num_rows:
                continue
            row, seg, word = index.told(b.column(0), b.column(1))
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))).astype(np.int32)
            once = np.unique(row * len(index.words) + word)
            found += np.bincount(once % max(len(index.words), 1), minlength=len(index.words))
            total += b.num_rows
            kinds = [c.type for c in b.columns[2:]]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (word, seg)),
                                              pa.array(np.zeros(b.num_rows, bool))], names=schema.names)
        if kinds is not None:
            has = np.flatnonzero(found)
            words, counts = [-1, *has.tolist()], [total, *found[has].tolist()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([words], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                                              pa.array([True])], names=schema.names)

    return written(df.mapInArrow(run, schema), "told")


def _weighted(examples: Examples, told: DataFrame) -> Examples:
    """`examples` weighted by the counts of all records."""
    pairs = told.filter("_counts").select(F.explode(F.arrays_zip("_words", "_segments")).alias("p"))
    counted = pairs.groupBy("p._words").agg(F.sum("p._segments").alias("n")).toPandas()  # a row a word of the sample
    counts = dict(zip(counted["_words"], counted["n"], strict=True))
    total = int(counts.pop(-1, 0))
    return examples.fit({w: int(counts.get(i, 0)) for w, i in examples.words.items()}, total)


def scored(records: DataFrame, labels: DataFrame, id: str = "anecdote_id", keep: list[str] = (), telling: float = TELLING) -> DataFrame:
    """(id, keep, score, evidence, cosine): score of each record in [0, 1] (problem 3).

    `evidence` is the labelled segment nearest to the record's worst one, null where no segment
    is near an abusive example; then the score is 0.  Null and empty texts and tags add nothing.
    Garbled texts are repaired first.  Without any usable label every score is 0.  The texts are
    read once: their known words are kept as numbers, and counting and scoring read those.
    """
    examples = examples_of(records, labels, id, telling)
    told = _told(records, examples, [id, *keep])
    examples = _weighted(examples, told)
    texts = [" ".join(examples.term_text(e)) for e in range(len(examples.votes))]
    shared = records.sparkSession.sparkContext.broadcast((examples, texts))  # bounded by SAMPLE records
    df = told.filter("not _counts").drop("_counts")
    schema = struct_of(df, [id, *keep], score=T.DoubleType(), evidence=T.StringType(), cosine=T.DoubleType())
    at = len(keep) + 1

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        index, names = shared.value
        words, segs = b.column(at), b.column(at + 1)
        row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(words.offsets, np.int64)))
        word, seg = (np.asarray(x.flatten()) for x in (words, segs))
        worst: list[tuple[float, tuple | None]] = [(0.0, None)] * b.num_rows
        if len(word):
            starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (seg[1:] != seg[:-1]))))
            ends = np.concatenate((starts[1:], [len(word)]))
            for k in np.flatnonzero(index.may_score(word, starts)):
                found = index.score_of(word[starts[k]:ends[k]].tolist())
                i = row[starts[k]]
                if found[0] > worst[i][0]:
                    worst[i] = found
        value, best = zip(*worst, strict=True)
        evidence, cosine = [names[x[0]] if x else None for x in best], [x[1] if x else None for x in best]
        return pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(value, pa.float64()), pa.array(evidence, pa.string()), pa.array(cosine, pa.float64())], names=schema.names)

    return map_batches(df, schema, one)
